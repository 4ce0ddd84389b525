"""Queries op1 to op10 over the test tables, each through its operator with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, language_id, mixing, ngram_join, order_minhash, page_text, pieces, substring_dedup, topk_search, toxicity
from .common import table, write_table
from .neighbours import neighbours, release

_BY_ID = "crc32(cast(doc_id as string))"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.link(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
    return got.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -1L as conv_id, t.* from values (0L, 'user', '{said}'), (1L, 'assistant', '{said}') as t(turn, role, text)")
    formatted = write_table(chat_windows.windows(turns.unionByName(more)), "windows")
    read = chat_windows.turns_of(formatted)
    part = F.struct("window", "place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("x"))
    whole = read.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), ""), 256).alias("turns_sha256"))
    loss = F.transform("loss_spans", lambda s: chat_windows.unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    masked = formatted.select("conv_id", "window", F.length("formatted").alias("size"), F.array_join(loss, "").alias("loss"))
    said_all = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "loss"))), lambda p: p["loss"]), "")
    masked = masked.groupBy("conv_id").agg(said_all.alias("loss"), F.sum("size").alias("formatted_chars"), F.count("*").alias("n_windows"))
    masked = masked.select(F.col("conv_id").alias("c"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
    return whole.join(masked, whole["conv_id"].eqNullSafe(masked["c"])).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.expr(f"coalesce({_BY_ID} % 3 = 1, false)")
    labels = table(spark, sf_dir, "labels").filter(f"{_BY_ID} % 3 != 1")
    model = toxicity.train(toxicity.labelled(docs, labels))
    got = toxicity.score(docs, model, out="score")
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: documents have no topic column: its stand-in is a bucket of the first word, a coarse class that content alone decides
TOPIC = r"concat('topic', pmod(cast(conv(substring(md5(regexp_extract(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)), 1, 8), 16, 10) as bigint), 6))"
#: soften the large sources and languages, level the topics
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(TOPIC)}, TARGETS)
    return got.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = page_text.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids: the next document is the one of that id with the greatest text; a null id comes last."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.groupBy("k").agg(F.max(F.length("text")).alias("n"))
    ends = keys.agg(F.min(F.struct("k", "n")).alias("low")).first()
    near = neighbours(keys, ["k"], ["k", "n"])
    low = ends["low"] or {"k": 0, "n": 0}
    # downwards by id: the next of a row is the one before it, and the one after it takes its first code points
    taker = F.coalesce("after", F.struct(F.lit(low["k"]).alias("k"), F.lit(low["n"]).alias("n")))
    chain = write_table(near.select("k", taker.alias("taker")), "chain")
    release(near)
    # fingerprinted before the exchange by k, which both uses below share
    docs = order_minhash.fingerprint(docs, {"text": "fp"}, dense=True)
    given = docs.join(chain, "k").select(F.col("taker.k").alias("to"), F.struct(F.expr("substring(text, 1, cast(floor(taker.n / 3) as int))").alias("start"), F.col("fp").alias("next_fp"), "doc_id").alias("given"))
    given = given.groupBy("to").agg(F.max("given").alias("given"))
    rows = docs.join(given, F.col("k") == F.col("to"), "left")
    n = F.length("text")
    cut = F.expr("cast(floor(length(text) / 3) as int)")
    rows = rows.select("doc_id", "fp", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("given.start", F.lit(1), cut)).alias("edited"), F.col("given.next_fp").alias("next_fp"))
    rows = order_minhash.fingerprint(rows, {"edited": "edited_fp"}, dense=True)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), order_minhash.as_text(F.col("fp")).alias("fingerprint"), order_minhash.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), order_minhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = table(spark, sf_dir, "embeddings").filter(whole).select("vec_id", F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"), F.expr("vec_id % 50 = 0").alias("asks"))
    got = topk_search.search(rows, "vec_id", "v", "asks", k=5)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.expr(f"coalesce({_BY_ID} % 4 = 2, false)")
    profiles = language_id.train(docs.filter(f"{_BY_ID} % 4 != 2"))
    got = language_id.identify(docs.select("doc_id", "text"), profiles)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_OP1_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from d)
), n as (
  select d.doc_id, count(s.g) as n from d left join s using (doc_id) group by d.doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select n.doc_id, n.n::bigint as n_shingles, least(n.doc_id, coalesce((select min(b) from reach where reach.a = n.doc_id), n.doc_id)) as component_id,
  (select count(*) from links where links.a = n.doc_id)::bigint as n_links
from n
"""

_OP2_SQL = r"""
with t as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), a as (
  select *, row_number() over (partition by c order by turn nulls first, md5(role || chr(10) || text)) as pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 as n from t
), b as (
  select *, pos = 1 and role = 'system' as is_system from a
), d as (
  select *, sum(case when is_system then n else 0 end) over w as sys_n, sum(case when is_system then 0 else n end) over w as through from b window w as (partition by c order by pos)
), e as (
  select *, through - case when is_system then 0 else n end as before, 512 - sys_n - 96 as room, greatest(1, floor((512 - sys_n - 96) / 2)) as half from d
), u as (
  select *, greatest(half, room - coalesce(max(case when n <= half then n end) over (partition by c), 0)) as unit from e
), f as (
  select *, floor(before / unit) as k, n > half and not is_system as big from u
), g as (
  select *, coalesce(k <> lag(k) over w or big or lag(big) over w, false) and pos > case when sys_n > 0 then 2 else 1 end as opens from f window w as (partition by c order by pos)
), h as (
  select *, sum(opens::int) over (partition by c order by pos) as span from g
), i as (
  select *, max(through) over (partition by c, span) as till, max(span) over (partition by c) as final,
    11 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&vert;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '|', '&vert;')) as size from h
)
select c as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(size * case when is_system then final + 1 when till - before <= 96 and span < final then 2 else 1 end)::bigint as formatted_chars, (max(final) + 1)::bigint as n_windows
from i group by c
"""


def _op4_sql(rounds: int = 12, plain: int = 4, keep: float = 0.5) -> str:
    """The raking of mixing.rake as a chain of common table expressions."""
    ctes = [
        r"""d as (select doc_id, source, lang, 'topic' || (('0x' || substr(md5(regexp_extract(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1, 8))::bigint % 6) as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents)""",
        "c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all)",
    ]
    for name, power in TARGETS.items():
        ctes.append(f"w_{name} as (select {name} as v, sum(tokens) as t, case when sum(tokens) > 0 then pow(sum(tokens)::double, {power}) else 0 end as w from c group by 1)")
        ctes.append(f"t_{name} as (select v, t, w / (select sum(w) from w_{name}) as share from w_{name})")
    allowed = ", ".join(f"(select min(t / share) from t_{n} where share > 0)" for n in TARGETS)
    ctes.append(f"most as (select least({keep} * (select sum(tokens) from c), {allowed}) as m)")
    shares = " ".join(f"join t_{n} on c.{n} is not distinct from t_{n}.v" for n in TARGETS)
    ctes.append(f"x0 as (select c.*, {', '.join(f't_{n}.share as m_{n}' for n in TARGETS)}, tokens * ((select m from most) / (select sum(tokens) from c)) as x from c {shares})")
    at = 0
    for k in range(rounds + plain):
        for name in TARGETS:
            given = "least(x, tokens)" if k < rounds else "x"
            ctes.append(f"x{at + 1} as (select * exclude (x), case when sum({given}) over w > 0 then x * (select m from most) * m_{name} / sum({given}) over w else 0 end as x from x{at} window w as (partition by {name}))")
            at += 1
        if k == rounds - 1:
            ctes.append(f"x{at + 1} as (select * exclude (x), least(x, tokens) as x from x{at})")
            at += 1
    ctes.append(f"p as (select source, lang, topic, x / (select sum(x) from x{at}) as weight, case when tokens > 0 then x / tokens / greatest(1, (select max(x / tokens) from x{at} where tokens > 0)) else 1 end as p from x{at})")
    return "with " + ",\n".join(ctes) + """
select doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 6) as weight, round(p, 6) as probability,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double / 281474976710656 < p as selected
from d join p on d.source is not distinct from p.source and d.lang is not distinct from p.lang and d.topic is not distinct from p.topic"""


_OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


_OP8_SQL = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50
), h as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from s
), m as (
  select h, min(doc_id) as least from h group by h
), late as (
  select h.doc_id, h.i from h join m using (h) where m.least < h.doc_id
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from late
), words as (
  select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d
), kept as (
  select a.doc_id, string_agg(a.x, ' ' order by a.p) as kept, count(*) as n from words a left join gone g on a.doc_id = g.doc_id and a.p = g.p
  where g.p is null group by a.doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join kept k using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1_SQL, "op2_chat_windows": _OP2_SQL, "op4_mixing": _op4_sql(), "op7_topk_search": _OP7_SQL, "op8_substring_dedup": _OP8_SQL}
