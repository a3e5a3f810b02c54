"""Merge, overlay, fold and structural diff of trees."""

from __future__ import annotations

from collections import Counter

from quillon.functions.canon import DocError, Num, render


def merge_patch(target, patch):
    """RFC 7396: patch nulls delete, objects recurse, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = merge_patch(out.get(k), v)
        else:
            out[k] = v
    return out


def overlay(base, patch):
    """base with the keys it lacks from patch; base's own nulls stay and nulls of patch add nothing."""
    if not isinstance(base, dict) or not isinstance(patch, dict):
        return base
    out = dict(base)
    for k, v in patch.items():
        if k in out:
            out[k] = overlay(out[k], v)
        elif v is not None:
            out[k] = _bare(v)
    return out


def _bare(v):
    return {k: _bare(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v


def without_nulls(v):
    """Objects without null members and without members that this empties."""
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        if x is None:
            continue
        if isinstance(x, dict):
            x = without_nulls(x)
            if not x:
                continue
        out[k] = x
    return out


def fold(acc, doc):
    """One step of the ordered group merge: later values win, nulls never overwrite, arrays replace."""
    if not isinstance(doc, dict):
        return doc
    if not isinstance(acc, dict):
        return without_nulls(doc)
    out = dict(acc)
    for k, v in doc.items():
        if v is None:
            continue
        if isinstance(v, dict):
            if isinstance(out.get(k), dict):
                out[k] = fold(out[k], v)
                continue
            v = without_nulls(v)
            if not v:
                continue
        out[k] = v
    return out


def same(a, b) -> bool:
    """Equality by representation: 1, 1.0 and true are three values."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a.text == b.text if isinstance(a, Num) else a == b


MODES = ("atomic", "counts", "elements")


def array_mode(mode: str) -> str:
    out = mode.strip().lower()
    if out not in MODES:
        raise DocError(f"arrays must be one of {', '.join(MODES)}, not {mode!r}")
    return out


def _arrays(prev, cur: list, mode: str):
    """The change of an array, or None for no change. prev is a list, or something else for an added array."""
    before = prev if isinstance(prev, list) else []
    if mode == "atomic":
        return None if isinstance(prev, list) and same(prev, cur) else cur
    old, new = [render(x) for x in before], [render(x) for x in cur]
    left, fresh = Counter(old), Counter(new)
    gone, come = left - fresh, fresh - left
    if not gone and not come:
        return None
    if mode == "counts":
        return {"added": sum(come.values()), "removed": sum(gone.values())}

    def last_of(items: list, texts: list[str], extra: Counter) -> list:
        skip = Counter(texts) - extra  # the first occurrences are the shared ones
        out = []
        for x, t in zip(items, texts, strict=True):
            if skip[t] > 0:
                skip[t] -= 1
            elif extra[t]:
                out.append(x)
        return out

    return {"added": last_of(cur, new, come), "removed": last_of(before, old, gone)}


def _objects(prev: dict, cur: dict, mode: str) -> dict:
    out = {}
    for k in prev:
        if k not in cur:
            out[k] = None
    for k, v in cur.items():
        had = k in prev
        old = prev.get(k)
        if isinstance(v, dict):
            if not isinstance(old, dict):
                out[k] = v if not isinstance(v, dict) or mode == "atomic" else _added(v, mode)
            elif change := _objects(old, v, mode):
                out[k] = change
        elif isinstance(v, list):
            change = _arrays(old, v, mode)
            if change is not None:
                out[k] = change
        elif not had or not same(old, v):
            out[k] = v
    return out


def _added(v: dict, mode: str) -> dict:
    """A new object: its arrays are deltas to nothing."""
    return _objects({}, v, mode)


def diff(prev, cur, mode: str = "atomic"):
    """What turns prev into cur: {} for nothing, null for removed keys. None (SQL NULL) is an empty document."""
    prev = {} if prev is NULL else prev
    cur = {} if cur is NULL else cur
    if isinstance(prev, dict) and isinstance(cur, dict):
        return _objects(prev, cur, mode)
    if isinstance(cur, list):
        change = _arrays(prev, cur, mode)
        return {} if change is None else change
    if isinstance(cur, dict):
        return cur if mode == "atomic" else _added(cur, mode)
    return {} if same(prev, cur) else cur


class _Null:
    pass


#: SQL NULL, which is not the JSON null.
NULL = _Null()
