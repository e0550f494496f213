"""Column functions: paths, package names, versions, text. All run inside the JVM."""
