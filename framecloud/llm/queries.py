"""One query per operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.llm import arrow_ids, bpe, chat, decontaminate, order_minhash, periodic_runs, piece_bpe, rp_forest, shard_tree, token_rollup, toxicity, warc, whitening
from framecloud.llm.storage import new_folder, written
from framecloud.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_OF_DOCUMENT = 2


def query(fn: Query) -> Query:
    """Register a function of (spark, folder) under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 16


@query
def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a tree, and where one more shard would put them."""
    tree = shard_tree.even_tree(SHARDS)
    return shard_tree.assign(table(spark, sf_dir, "documents"), tree, tree.grown(SHARDS))


def _shard_sql() -> str:
    tree = shard_tree.even_tree(SHARDS)
    base = shard_tree.draw_sql("name", tree)
    more = shard_tree.draw_sql("name", tree.grown(SHARDS))
    ctes = []
    for side, sql in (("a", base), ("b", more)):
        src = "named_root"
        for k in range(3):
            body = f"""{side}{k} as (select d.rid, any_value(d.name) as name, arg_min(n.next, {sql["score"]}) as node
  from {src} d join {sql["nodes"]} on n.parent = d.node group by d.rid)"""
            ctes.append(body)
            src = f"{side}{k}"
    return f"""
with named as (
  select row_number() over () as rid, doc_id, coalesce(doc_id::varchar, 'null') as name,
         cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, hex(encode(coalesce(text, ''))) as digits
  from documents),
crc_table as (
  select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
sums as (
  select rid, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
    string_split(regexp_replace(digits, '(..)', '\\1,', 'g'), ',')[:-2], lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from named, crc_table),
named_root as (select rid, name, 0 as node from named),
{", ".join(ctes)},
placed as (
  select n.doc_id, n.size, s.text_crc32, a2.node as shard, b2.node as grown_shard,
         ('0x' || substr(md5(n.name), 1, 3))::int as piece
  from named n join sums s using (rid) join a2 using (rid) join b2 using (rid))
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard,
       row_number() over (partition by shard order by piece, doc_id, text_crc32, size) - 1 as slot,
       cast(grown_shard as int) as grown_shard
from placed"""


SQL["op2_shard_tree"] = _shard_sql()


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back by byte ranges."""
    pages = warc.with_record_types(table(spark, sf_dir, "pages"))
    manifest = warc.write_archives(pages, new_folder(spark, "warc"))
    read = warc.read_archives(warc.splits(manifest))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha256(payload) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
       case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first < page_id then first end as refers_to
from f"""


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the documents after three batches, one of them sent twice.

    Batch 1 inserts every document with a provisional count of words. Batch 2
    revises every count to the tokenizer's. Batch 3 deletes the copies of equal
    texts but the one with the smallest id. Counts and text digests are written
    once; the batches read those.
    """
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "words": F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint"),
            "digest": F.sha2(F.coalesce("text", F.lit("")), 256),
        }
    )
    folder = new_folder(spark, "token-rollup")
    counted = written(token_rollup.count_tokens(docs, public_tokenizers.path(BYTE_BPE)), f"{folder}/counts")
    side = token_rollup.side
    words = side(F.col("source"), F.col("lang"), F.lit("words"), F.col("words"))
    tokens = side(F.col("source"), F.col("lang"), F.lit("byte_bpe_50k"), F.col("tokens"))
    change = lambda df, before, after: df.select(before.alias("before"), after.alias("after"))
    nothing = token_rollup.nothing()
    firsts = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = counted.join(firsts, "digest").where("doc_id > first")
    rollup = token_rollup.Rollup(spark, f"{folder}/totals")
    rollup.commit(1, change(counted, nothing, words))
    rollup.commit(2, change(counted, words, tokens))
    rollup.commit(2, change(counted, words, tokens))
    rollup.commit(3, change(copies, tokens, nothing))
    return rollup.totals()


@query
def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


SQL["op7_chat_snapshots"] = chat.SQL


@query
def op8_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the written files."""
    path = public_tokenizers.path(WORD_BPE)
    folder = new_folder(spark, "arrow-ids")
    manifest = arrow_ids.write_sequences(table(spark, sf_dir, "documents"), folder, path, END_OF_DOCUMENT)
    return arrow_ids.read_documents(manifest)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that never saw the held-out rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = order_minhash.near_duplicates(table(spark, sf_dir, "documents"), new_folder(spark, "near"))
    return found.select("doc_id", "class_id", "is_first")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items, new_folder(spark, "decontaminate"))


@query
def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return rp_forest.nearest(vectors, F.col("vec_id") % 50 == 0, new_folder(spark, "forest"))


@query
def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded into pieces and decoded again."""
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def _with_long_tails(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by id, with their words from some place on repeating.

    With h the crc32 of the decimal id and g its tenth, word i from a = g mod n on becomes
    word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    g, n, a, p = (F.col(c) for c in ("_g", "_n", "_a", "_p"))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    repeated = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("_words", place(i).cast("int")))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words").cast("bigint"))
    placed = chosen.withColumn("_g", F.expr("crc32(cast(doc_id as string)) div 10")).withColumn(
        "_a", F.when(n > 0, g % n)
    )
    with_period = placed.withColumn("_p", 1 + F.expr("(_n - _a) div (3 + _g % 8)"))
    text = F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return with_period.select("doc_id", text.alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and digests of them and of what stays."""
    docs = _with_long_tails(table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(docs)
    denser = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(denser(b, r), r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


COMPONENTS = 16


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first components of the whitened space."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, new_folder(spark, "whitening"), components=COMPONENTS)
    cells = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return cells.select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "col.whitened",
        "col.explained",
        "identity_error",
    )
