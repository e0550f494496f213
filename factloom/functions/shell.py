"""Commands of shell scripts: a small lexer that runs on one script at a time."""

from __future__ import annotations

# Words that begin or end what shells group, and programs that run another.
OPENERS = frozenset("if then else elif do while until ! { time exec command".split())
CLOSERS = frozenset("fi done esac } ;;".split())
HEADERS = frozenset("for case select function".split())
SHELLS = frozenset("sh bash zsh dash ksh".split())
#: Programs that run what follows, with the flags that take a value.
WRAPPERS = {
    "npx": ("-p", "--package"), "bunx": ("-p", "--package"), "cross-env": (), "env": ("-u", "--unset", "-C", "--chdir"), "nice": ("-n",), "sudo": ("-u", "-g", "-h", "-C"), "nohup": (), "xargs": ("-n", "-I", "-P", "-L", "-d", "-a"),
    "dotenv": ("-e", "-f", "-c"), "pnpm exec": (), "pnpm dlx": ("--package",), "yarn exec": (), "yarn dlx": ("-p", "--package"), "npm exec": ("-p", "--package"), "pnpx": (), "dotenvx run": ("-f", "-e"),
}
#: Programs whose quoted arguments are scripts.
RUNNERS = frozenset("concurrently cross-env-shell".split())
#: Scripts within scripts that are followed.
NESTING = 8


class Word(str):
    """A word of a command, and whether any of it was quoted or computed."""

    quoted = False
    computed = False


def lexed(script: str) -> tuple[list[list[Word]], list[str]]:
    """(commands as lists of words, what could not be read).

    A machine over characters: outside quotes, within single ones, or within double ones.
    A backslash takes the next character as it is (and a line end away), # begins a comment
    where a word could begin, and operators end a command.  Targets of redirections are no
    words.  What is computed ($x, `x`, $(x)) is marked, and its text is kept as one word.
    """
    commands: list[list[Word]] = [[]]
    gaps: list[str] = []
    text: list[str] = []
    held = quoted = computed = skip = False  # a word has begun; its marks; it is a redirection's target
    state, i, n = "", 0, len(script)

    def end_word() -> None:
        nonlocal held, quoted, computed, skip
        if held:
            word = Word("".join(text))
            word.quoted, word.computed = quoted, computed
            if not skip:
                commands[-1].append(word)
            skip = False
        text.clear()
        held = quoted = computed = False

    def end_command() -> None:
        end_word()
        if commands[-1]:
            commands.append([])

    while i < n:
        c = script[i]
        after = script[i + 1] if i + 1 < n else ""
        if state == "'":
            if c == "'":
                state = ""
            else:
                text.append(c)
        elif c == "\\" and (not state or after in '"\\$`\n'):
            if after == "\r" and script[i + 2 : i + 3] == "\n":
                i += 1
                after = "\n"
            if after != "\n":
                text.append(after or "\\")
                held = quoted = True
            i += 1
        elif c == "$" and after == "(" or c == "`":
            close = _closing(script, i)
            if close < 0:
                gaps.append("unterminated substitution")
                close = n - 1
            gaps.append("substitution")
            text.append(script[i : close + 1])
            held = computed = True
            i = close
        elif c == "$" and (after.isalnum() or after in "_{@*#?!"):
            text.append(c)
            held = computed = True
        elif state == '"':
            if c == '"':
                state = ""
            else:
                text.append(c)
        elif c in "'\"":
            state, held, quoted = c, True, True
        elif c == "#" and not held:
            while i + 1 < n and script[i + 1] != "\n":
                i += 1
        elif c in " \t\r":
            end_word()
        elif c in "<>":
            if held and "".join(text).isdigit() and not quoted:
                text.clear()
                held = False
            end_word()
            if script[i : i + 2] == "<<":
                gaps.append("here-document")
            while i + 1 < n and script[i + 1] in "<>&|":
                i += 1
            skip = True
        elif c in "\n;|&()":
            if c == "&" and after == ">":  # &> file
                end_word()
            else:
                end_command()
                skip = False
        else:
            text.append(c)
            held = True
        i += 1
    if state:
        gaps.append("unterminated quote")
    end_command()
    return [c for c in commands if c], gaps


def _closing(script: str, at: int) -> int:
    """Where the substitution that begins at ``at`` ends, -1 if it does not."""
    if script[at] == "`":
        i = at + 1
        while i < len(script) and script[i] != "`":
            i += 2 if script[i] == "\\" else 1
        return i if i < len(script) else -1
    depth, i, state = 0, at + 1, ""
    while i < len(script):
        c = script[i]
        if state:
            if c == "\\" and state == '"':
                i += 1
            elif c == state:
                state = ""
        elif c == "\\":
            i += 1
        elif c in "'\"":
            state = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _assigns(word: Word) -> bool:
    name, sign, _ = word.partition("=")
    return bool(sign) and name.isidentifier() and name.isascii()


def _flagged(words: list[Word], i: int, valued: tuple[str, ...]) -> int:
    """The place after the flags at ``i``."""
    while i < len(words) and words[i].startswith("-"):
        if words[i] == "--":
            return i + 1
        i += 2 if words[i] in valued else 1
    return i


def commands(script: str | None, depth: int = 0) -> tuple[list[str], list[str]]:
    """(the words that are run, what could not be read) of a script, in order.

    Assignments, what groups commands, and programs that run others are passed over, and
    scripts in an argument (sh -c, concurrently) are read too, up to ``NESTING`` deep.
    """
    found, (lists, gaps) = [], lexed(script or "")
    for words in lists:
        i = 0
        while i < len(words):
            word = words[i]
            two = f"{word} {words[i + 1]}" if i + 1 < len(words) else ""
            plain = not word.quoted
            if plain and (word in HEADERS or word in CLOSERS):
                break
            if (plain and word in OPENERS) or _assigns(word):
                i += 1
            elif two in WRAPPERS or word in WRAPPERS:
                name = two if two in WRAPPERS else word
                i = _flagged(words, i + (2 if name == two else 1), WRAPPERS[name])
            elif word in SHELLS and (script_at := next((k + 1 for k in range(i + 1, len(words)) if words[k].startswith("-") and not words[k].startswith("--") and words[k].endswith("c")), 0)):
                found.append(str(word))
                if script_at < len(words):
                    _nested(words[script_at : script_at + 1], depth, found, gaps)
                break
            elif word in RUNNERS:
                found.append(str(word))
                _nested([w for w in words[i + 1 :] if w.quoted and not w.startswith("-")], depth, found, gaps)
                break
            else:
                if word.computed:
                    gaps.append("computed command")
                elif word:
                    found.append(str(word))
                break
    return found, gaps


def _nested(scripts: list[Word], depth: int, found: list[str], gaps: list[str]) -> None:
    for script in scripts:
        if depth == NESTING:
            gaps.append("nested too deep")
        elif script.computed and script.startswith("$"):
            gaps.append("computed command")
        else:
            inner, unread = commands(str(script), depth + 1)
            found += inner
            gaps += unread
