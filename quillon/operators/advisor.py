"""Advice on shredding: which lanes a corpus suggests, and how well the lanes of a shredded one serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import canon, coerce, path as P
from quillon.functions.canon import DocError
from quillon.functions.columns import _udf
from quillon.operators import shred as S

#: In order of preference.
LADDER = ("BIGINT", "UBIGINT", "DOUBLE", "BOOLEAN", "VARCHAR")
MAX_DEPTH, MAX_PATHS = 16, 8192
_EPS = 1e-9

_FACT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sub", T.StringType()),
        T.StructField("role", T.StringType()),
        *[T.StructField(k, T.LongType()) for k in LADDER],
    ]
)


def _name(keys: tuple[str, ...]) -> str:
    if len(keys) == 1 and keys[0] != "body" and not keys[0].startswith("$"):
        return keys[0]
    return P.text(keys)


def _fits(v) -> list[int]:
    return [1] * len(LADDER) if v is None else [int(coerce.fits(v, k)) for k in LADDER]


def _facts(text: str) -> list[tuple]:
    """What one document says of its paths: (path, subfield, role, fit of each type)."""
    tree = canon.parse(text)
    out: list[tuple] = []
    if not isinstance(tree, dict):
        return out

    def walk(v: dict, keys: tuple[str, ...]) -> None:
        for k, x in v.items():
            if not k:
                continue
            at = (*keys, k)
            name = _name(at)
            if isinstance(x, dict):
                out.append((name, None, "object", *[0] * 5))
                if len(at) < MAX_DEPTH:
                    walk(x, at)
            elif isinstance(x, list):
                out.append((name, None, "array", *[0] * 5))
                if len(at) == 1:
                    array(name, x)
            else:
                out.append((name, None, "scalar", *_fits(x)))

    def array(name: str, items: list) -> None:
        objects = [e for e in items if isinstance(e, dict)]
        if objects:
            out.append((name, None, "objects", *[0] * 5))
        plain = [e for e in items if not isinstance(e, dict) and e is not None]
        if plain:
            fit = [min(c) for c in zip(*map(_fits, plain), strict=True)]
            out.append((name, None, "scalars", *fit))
        seen: dict[str, list[int]] = {}
        for e in objects:
            for k, x in e.items():
                if k:
                    one = [0] * 5 if isinstance(x, dict | list) else _fits(x)
                    seen[k] = [min(p) for p in zip(seen[k], one, strict=True)] if k in seen else one
        out.extend((name, k, "sub", *fit) for k, fit in seen.items())

    walk(tree, ())
    return out


def suggest_shredding(df: DataFrame, doc: str, *, min_presence: float = 0.5, min_fit: float = 1.0) -> str | None:
    """A shredding spec for the plain documents of a column, or None if no path qualifies.

    A path needs values in min_presence of the documents, and a type that fits min_fit of all documents with the path.
    Counts are gathered per path, subfield and role in one aggregation. More than 8192 paths are an error, and so are more
    than 8192 subfields of one array; below that, every count that can matter reaches the driver.
    """
    for name, v in (("min_presence", min_presence), ("min_fit", min_fit)):
        if not 0 <= v <= 1:
            raise DocError(f"{name} must be in [0, 1]")
    if isinstance(df.schema[doc].dataType, T.StructType):
        raise DocError("suggest_shredding needs plain documents")
    d = F.col(f"`{doc}`")
    n_rows = df.where(d.isNotNull()).count()
    facts = _udf(T.ArrayType(_FACT), lambda t: [dict(zip(_FACT.fieldNames(), f, strict=True)) for f in _facts(t)], d)
    per = (
        df.select(F.explode(facts).alias("f"))
        .select("f.*")
        .groupBy("path", "sub", "role")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in LADDER])
    )
    per = per.persist()
    try:
        sub = F.col("role") == "sub"
        if per.where(~sub).select("path").distinct().count() > MAX_PATHS:
            raise DocError(f"more than {MAX_PATHS} distinct paths")
        widest = per.where(sub).groupBy("path").count().agg(F.max("count")).first()[0] or 0
        if widest > MAX_PATHS:
            raise DocError(f"an array with more than {MAX_PATHS} distinct subfields")
        by: dict[str, dict] = {}
        for r in per.where(~sub).collect():  # a few roles for each of MAX_PATHS paths
            by.setdefault(r["path"], {})[r["role"]] = r
        subs: dict[str, dict] = {}
        objects = per.where("role = 'objects'").select("path", F.col("n").alias("of"))
        often = per.where(sub).join(objects, "path").where(F.col("n") + F.lit(_EPS) >= F.lit(float(min_presence)) * F.col("of"))
        for r in often.collect():
            subs.setdefault(r["path"], {})[r["sub"]] = r
    finally:
        per.unpersist()
    return spec_text(choose(by, subs, n_rows, min_presence, min_fit))


def _pick(row, carried: int, min_fit: float) -> str | None:
    return next((k for k in LADDER if row[k] + _EPS >= min_fit * carried and row[k] > 0), None)


def choose(by: dict, subs: dict, n_rows: int, min_presence: float, min_fit: float) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, roles in by.items():
        n = {k: r["n"] for k, r in roles.items()}
        carried = n.get("scalar", 0) + n.get("object", 0) + n.get("array", 0)
        best = (0, None)
        if "scalar" in roles and n["scalar"] + _EPS >= min_presence * n_rows and (kind := _pick(roles["scalar"], carried, min_fit)):
            best = (n["scalar"], kind)
        rows = n.get("array", 0)
        if rows and rows + _EPS >= min_presence * n_rows and rows + _EPS >= min_fit * carried:
            if "scalars" in roles and rows > best[0]:
                mixed = n.get("objects", 0)
                kind = _pick(roles["scalars"], n["scalars"] + mixed, min_fit)
                if kind and (not mixed or min_fit < 1):
                    best = (rows, kind + "[]")
            if "objects" in roles and rows > best[0] and not (n.get("scalars") and min_fit >= 1):
                fields = []
                for sub, r in sorted(subs.get(name, {}).items()):
                    if r["n"] + _EPS >= min_presence * n["objects"] and (kind := _pick(r, r["n"], min_fit)):
                        fields.append(f"{S.identifier(sub)} {kind}")
                if fields:
                    best = (rows, f"STRUCT({', '.join(fields)})[]")
        if best[1]:
            out[name] = best[1]
    return out


def spec_text(spec: dict[str, str]) -> str | None:
    """`{name: 'TYPE', "$.a.b": 'TYPE'}`, sorted by path."""
    if not spec:
        return None
    quoted = {k: v.replace("'", "''") for k, v in spec.items()}
    return "{" + ", ".join(f"{S.identifier(k)}: '{quoted[k]}'" for k in sorted(quoted)) + "}"


def parse_spec(text: str) -> dict[str, str]:
    """The mapping that spec_text has written."""
    import re

    out = {}
    for m in re.finditer(r"""(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*))\s*:\s*'((?:[^']|'')*)'""", text):
        out[m[2] if m[1] is None else m[1].replace('""', '"')] = m[3].replace("''", "'")
    return out


def shred_stats(document: Column, spec: dict | S.Spec) -> Column:
    """An aggregate over shredded documents: per lane, by path, the share of rows in the lane and of rows left behind."""
    spec = S.Spec.of(spec)
    live = document.isNotNull()
    n = F.count(F.when(live, 1))
    out, bit = [], 0
    for x in spec.lanes:
        lane = document["shreds"].getField(x.name)
        here = F.avg(F.when(live, lane.isNotNull().cast("double")))
        left = F.lit(0.0)
        if x.scalar:
            word = document["shreds"].getField(f"{S.SPILL}{bit // S.BITS}")
            left = F.avg(F.when(live, (F.coalesce(word, F.lit(0)).bitwiseAND(F.lit(1 << (bit % S.BITS))) != 0).cast("double")))
            bit += 1
        out.append(F.struct(F.lit(x.name).alias("path"), F.lit(x.ddl).alias("type"), here.alias("lane_rate"), left.alias("divert_rate")))
    return F.when(n > 0, F.array(*out))
