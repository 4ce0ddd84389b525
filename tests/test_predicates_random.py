"""Random filters over random rows, against an evaluation in plain Python that follows the definitions word by word."""

import random

from pyspark.sql import functions as F

from parqyard import Table
from parqyard import types as P
from parqyard.operators.predicates import Compare, Named, Set, compile_all

KINDS = {"i": P.INT32, "j": P.INT32, "l": P.INT64, "d": P.DOUBLE, "s": P.BYTE_ARRAY, "t": P.BYTE_ARRAY, "xs": "list", "m": "map"}
VALUES = {P.INT32: [-1, 0, 1, 2], P.INT64: [0, 1, 2], P.DOUBLE: [-0.5, 0.5, 1.0], P.BYTE_ARRAY: ["", "a", "ab", "ba", "é"]}


def literal(rnd):
    kind = rnd.choice(list(VALUES))
    return P.Literal(kind, rnd.choice(VALUES[kind]))


def value(rnd):
    r = rnd.random()
    if r < 0.7:
        return literal(rnd)
    if r < 0.8:
        return None
    if r < 0.9:
        return [rnd.choice([None, P.I32(0), P.I32(1), P.I64(1)]) for _ in range(rnd.randint(0, 2))]
    return {P.Str(k): rnd.choice([None, P.Str("a"), P.I32(1)]) for k in rnd.sample(["a", "b"], rnd.randint(0, 2))}


def tree(rnd, depth=0):
    r = rnd.random()
    if depth < 3 and r < 0.35:
        return Set(rnd.choice(("All", "Any")), tuple(tree(rnd, depth + 1) for _ in range(rnd.randint(0, 3))))
    if depth < 3 and r < 0.5:
        return Named(rnd.choice(list(KINDS)), tree(rnd, depth + 1))
    op = rnd.choice(("eq", "neq", "lt", "lte", "gt", "gte", "contains", "prefix", "suffix", "isNull", "isNotNull"))
    if op in ("lt", "lte", "gt", "gte"):
        return Compare(op, literal(rnd))
    if op in ("prefix", "suffix"):
        return Compare(op, P.Str(rnd.choice(VALUES[P.BYTE_ARRAY])))
    return Compare(op, None if op in ("isNull", "isNotNull") else value(rnd))


def same(kind, v, m):
    """Whether a non-null value of a column equals a literal, kinds included."""
    if kind == "list":
        return isinstance(m, list) and len(v) == len(m) and all(x is None and y is None or x is not None and y is not None and y.kind == P.INT32 and x == y.value for x, y in zip(v, m)) and all(y is None or y.kind == P.INT32 for y in m)
    if kind == "map":
        return isinstance(m, dict) and all(y is None or y.kind == P.BYTE_ARRAY for y in m.values()) and v == {k.value: y and y.value for k, y in m.items()}
    return isinstance(m, P.Literal) and m.kind == kind and v == m.value


def met(p, name, v):
    kind = KINDS[name]
    if isinstance(p, Set):
        return (all if p.join == "All" else any)(met(q, name, v) for q in p.members)
    if isinstance(p, Named):
        return name == p.name and met(p.inner, name, v)
    m = p.value
    if p.op == "isNull":
        return v is None
    if p.op == "isNotNull":
        return v is not None
    if p.op == "neq":
        return m is not None if v is None else m is None or not same(kind, v, m)
    if v is None or m is None:
        return False
    if p.op == "eq":
        return same(kind, v, m)
    if p.op == "contains" and kind == "list":
        return isinstance(m, P.Literal) and m.kind == P.INT32 and m.value in v
    if not isinstance(m, P.Literal) or m.kind != kind:
        return False
    if p.op in ("lt", "lte", "gt", "gte"):
        a, b = (v.encode(), m.value.encode()) if kind == P.BYTE_ARRAY else (v, m.value)
        return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[p.op]
    if kind != P.BYTE_ARRAY:
        return False
    return {"contains": m.value in v, "prefix": v.startswith(m.value), "suffix": v.endswith(m.value)}[p.op]


def test_random_filters(spark):
    rnd = random.Random(20)
    pick = lambda kind: None if rnd.random() < 0.2 else rnd.choice(VALUES[kind])
    rows = []
    for _ in range(60):
        xs = None if rnd.random() < 0.2 else [rnd.choice([None, 0, 1]) for _ in range(rnd.randint(0, 2))]
        m = None if rnd.random() < 0.2 else {k: rnd.choice([None, "a", "b"]) for k in rnd.sample(["a", "b"], rnd.randint(0, 2))}
        rows.append((pick(P.INT32), pick(P.INT32), pick(P.INT64), pick(P.DOUBLE), pick(P.BYTE_ARRAY), pick(P.BYTE_ARRAY), xs, m))
    df = spark.createDataFrame(rows, "i int, j int, l long, d double, s string, t string, xs array<int>, m map<string,string>").coalesce(1)
    table = Table.of(df)
    for _ in range(4):
        filters = [[tree(rnd) for _ in range(rnd.randint(0, 3))] for _ in range(40)]
        flags = []
        for k, ps in enumerate(filters):
            got = compile_all(ps, table.schema.columns)
            flags.append((F.lit(got) if isinstance(got, bool) else F.coalesce(got, F.lit(False))).alias(f"r{k}"))
        for row, found in zip(rows, df.select(*flags).collect()):
            for k, ps in enumerate(filters):
                want = all(any(met(p, n, v) for n, v in zip(KINDS, row)) for p in ps)
                assert found[f"r{k}"] is want, (ps, row)
