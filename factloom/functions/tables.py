"""Names of packages, the commands and modules that they provide, and
packages that tools use without an import."""

BINS = {
    "typescript": ["tsc", "tsserver"], "@biomejs/biome": ["biome"], "@angular/cli": ["ng"], "@nestjs/cli": ["nest"], "@vue/cli-service": ["vue-cli-service"], "@playwright/test": ["playwright"],
    "@changesets/cli": ["changeset", "changesets"], "@storybook/cli": ["sb", "storybook"], "npm-run-all": ["npm-run-all", "run-s", "run-p"], "npm-run-all2": ["npm-run-all", "run-s", "run-p"], "concurrently": ["concurrently", "conc"],
    "@swc/cli": ["swc", "spack"], "@babel/cli": ["babel", "babel-external-helpers"], "@microsoft/api-extractor": ["api-extractor"], "ts-node": ["ts-node", "ts-node-esm", "ts-node-script", "ts-node-transpile-only"],
    "@commitlint/cli": ["commitlint"], "webpack-cli": ["webpack-cli", "webpack"],
}

PYTHON_MODULES = {
    "attr": ["attrs"], "bs4": ["beautifulsoup4"], "cv2": ["opencv-python", "opencv-python-headless", "opencv-contrib-python", "opencv-contrib-python-headless"], "Crypto": ["pycryptodome", "pycrypto"], "Cryptodome": ["pycryptodomex"],
    "dateutil": ["python-dateutil"], "docx": ["python-docx"], "dotenv": ["python-dotenv"], "fitz": ["pymupdf"], "git": ["gitpython"], "google.auth": ["google-auth"], "google.cloud.bigquery": ["google-cloud-bigquery"],
    "google.cloud.pubsub": ["google-cloud-pubsub"], "google.cloud.pubsub_v1": ["google-cloud-pubsub"], "google.cloud.storage": ["google-cloud-storage"], "google.oauth2": ["google-auth"], "google.protobuf": ["protobuf"],
    "googleapiclient": ["google-api-python-client"], "jose": ["python-jose"], "jwt": ["pyjwt"], "magic": ["python-magic"], "MySQLdb": ["mysqlclient"], "multipart": ["python-multipart"], "OpenSSL": ["pyopenssl"], "PIL": ["pillow"],
    "pkg_resources": ["setuptools"], "pptx": ["python-pptx"], "psycopg2": ["psycopg2", "psycopg2-binary"], "serial": ["pyserial"], "six": ["six"], "skimage": ["scikit-image"], "sklearn": ["scikit-learn"], "slugify": ["python-slugify"],
    "usb": ["pyusb"], "win32api": ["pywin32"], "win32con": ["pywin32"], "yaml": ["pyyaml"], "zmq": ["pyzmq"], "zope.component": ["zope-component"], "zope.deprecation": ["zope-deprecation"], "zope.event": ["zope-event"],
    "zope.i18nmessageid": ["zope-i18nmessageid"], "zope.interface": ["zope-interface"], "zope.proxy": ["zope-proxy"], "zope.schema": ["zope-schema"], "zope.security": ["zope-security"],
}

TOOLS = {
    "javascript-typescript": {
        "exact": [
            "typescript", "tslib", "tsx", "ts-node", "eslint", "typescript-eslint", "prettier", "@biomejs/biome", "stylelint", "vitest", "jest", "mocha", "ava", "tap", "c8", "nyc", "playwright", "@playwright/test", "cypress",
            "vite", "esbuild", "rollup", "webpack", "webpack-cli", "parcel", "tsup", "turbo", "nx", "@swc/core", "@babel/core", "@babel/cli", "husky", "lint-staged", "nodemon", "concurrently", "npm-run-all", "npm-run-all2", "rimraf", "cross-env", "semantic-release", "release-please",
        ],
        "prefixes": [
            "eslint-config-", "eslint-plugin-", "@eslint/", "@typescript-eslint/", "prettier-plugin-", "@vitejs/", "vite-plugin-", "@rollup/", "rollup-plugin-", "@babel/preset-", "@babel/plugin-", "babel-plugin-", "babel-preset-", "@swc/", "@commitlint/", "@changesets/", "stylelint-config-",
        ],
    },
    "python": {
        "exact": ["pytest", "coverage", "black", "ruff", "mypy", "flake8", "isort", "pylint", "pre-commit", "tox", "nox", "build", "twine", "hatchling", "setuptools", "wheel"],
        "prefixes": ["pytest-", "flake8-", "types-", "mypy-"],
    },
}
