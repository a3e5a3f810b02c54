"""Path grammar: `$`, `.key`, `."quoted key"`, `[n]` and one `[*]`; bare strings are literal top-level keys."""

from __future__ import annotations

from quillon.functions.canon import DocError


class _Wild:
    def __repr__(self):
        return "[*]"

    def __reduce__(self):
        return "WILD"


WILD = _Wild()
Step = str | int | _Wild
Path = tuple[Step, ...]


def is_wild(step: Step) -> bool:
    return isinstance(step, _Wild)


def parse(text: str, *, wildcard: bool = False) -> Path:
    """Steps of a `$`-rooted path."""
    if not text or text[0] != "$":
        raise DocError(f"path must start with $: {text!r}")
    out: list[Step] = []
    i, n = 1, len(text)
    while i < n:
        if text[i] == ".":
            i += 1
            if i < n and text[i] == '"':
                key, i = _quoted(text, i + 1)
            else:
                j = i
                while j < n and text[j] not in ".[":
                    j += 1
                key, i = text[i:j], j
                if not key:
                    raise DocError(f"empty key in path {text!r}")
            out.append(key)
        elif text[i] == "[" and i > 1:
            j = text.find("]", i)
            if j < 0:
                raise DocError(f"unclosed [ in path {text!r}")
            inner, i = text[i + 1 : j], j + 1
            if inner == "*":
                if any(map(is_wild, out)):
                    raise DocError(f"at most one wildcard in path {text!r}")
                out.append(WILD)
            elif inner.startswith("-"):
                raise DocError("negative array index is not supported")
            elif inner.isascii() and inner.isdigit():
                if int(inner) >= 2**63:
                    raise DocError(f"array index out of range in path {text!r}")
                out.append(int(inner))
            else:
                raise DocError(f"invalid array index in path {text!r}")
        else:
            raise DocError(f"invalid path {text!r}")
    if not wildcard and any(map(is_wild, out)):
        raise DocError(f"wildcard is not allowed in path {text!r}")
    return tuple(out)


def _quoted(text: str, i: int) -> tuple[str, int]:
    out = []
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append(text[i + 1])
            i += 2
        elif text[i] == '"':
            return "".join(out), i + 1
        else:
            out.append(text[i])
            i += 1
    raise DocError(f"unclosed quote in path {text!r}")


def of(path: str | int, *, strict: bool = False, wildcard: bool = False) -> Path:
    """A path argument: `$...`, else an array index or a literal top-level key unless strict."""
    if isinstance(path, bool) or path is None or path == "":
        raise DocError("path must be a non-empty constant")
    if isinstance(path, int):
        if strict:
            raise DocError("path must start with $")
        if path < 0:
            raise DocError("array index must be non-negative")
        return (path,)
    if path.startswith("$"):
        return parse(path, wildcard=wildcard)
    if strict:
        raise DocError(f"path must start with $: {path!r}")
    return (path,)


def key_text(key: str) -> str:
    """A key as it stands in a path; quoted if it is empty or has one of `. [ ] "`."""
    if not key or any(c in '.[]"' for c in key):
        return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return key


def text(path: Path) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "[*]" if is_wild(s) else f".{key_text(s)}" for s in path)


MISSING = object()


def get(tree, path: Path):
    """The value at a path without wildcard, or MISSING."""
    for step in path:
        if isinstance(step, str):
            if not isinstance(tree, dict) or step not in tree:
                return MISSING
            tree = tree[step]
        else:
            if not isinstance(tree, list) or step >= len(tree):
                return MISSING
            tree = tree[step]
    return tree
