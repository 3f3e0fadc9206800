"""How far the sources of a language differ in the words they use.

Counting and comparing are SQL that DuckDB runs over shards inside the tasks:
first over slices of texts (occurrences and documents of every term), then,
dealt out by language and term, over the summed counts of a shard's terms.
Spark deals out the shards, adds their sums up and ranks.

A shard is read in order of its terms and handed to DuckDB a stretch of whole
terms at a time, so no task holds a shard; of a term that fills a stretch by
itself the counts are summed first. A term that is everywhere comes as one row
a slice and source, not a row a document.

Two sources are compared over all kept terms of their language, most of which
neither may have. With p0 the share of a term that a source lacks, V the number
of terms and d0 = |p0(s) - p0(t)|, the sum over all terms is

    V d0 + sum over s's terms (|p - p0(t)| - d0) + the same for t's
         + sum over the terms of both (|p - p'| - |p - p0(t)| - |p' - p0(s)| + d0),

so shards only look at counts that occur. The first two sums depend on s's
shares alone and are taken over its distinct shares. All arithmetic is exact:
128-bit integers in DuckDB, decimals in Spark where a long might not do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed, join_unique, slices, stored

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Rows of counts that DuckDB gets at once, and bytes of text.
STRETCH = 1 << 18
SLICE = 8 << 20
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The empty term stands for a group that may have no other.
_COUNT = f"""
WITH rows AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM part),
terms AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM rows),
each_doc AS (SELECT lang, source, doc, term, count(*) AS n FROM terms GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM each_doc GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM rows
"""
_SUM = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM part GROUP BY ALL"
_KEEP = f"""
WITH sums AS ({_SUM}),
totals AS (SELECT *, sum(docs) OVER t AS in_docs, CAST(sum(n) OVER t AS BIGINT) AS total, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS k
  FROM sums WINDOW t AS (PARTITION BY lang, term))
SELECT lang, source, term, n, total, CAST(k = 1 AND term <> '' AS INT) AS first_of_term FROM totals WHERE term = '' OR in_docs >= {{min_docs}}
"""
_COMPARE = f"""
WITH shares AS (
  SELECT lang, source, term, 1 + {SCALE}::HUGEINT * (n + {SMOOTHING}) // (size + {SMOOTHING}::HUGEINT * terms) AS p,
    1 + {SCALE}::HUGEINT * (total + {SMOOTHING}) // (lang_size + {SMOOTHING}::HUGEINT * terms) AS q,
    1 + {SCALE * SMOOTHING}::HUGEINT // (size + {SMOOTHING}::HUGEINT * terms) AS p0 FROM part),
best AS (SELECT lang, source, term, p - q AS value FROM shares WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) <= {{top}}),
shared AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT 'term' AS part, lang, source, term AS item, CAST(value AS BIGINT) AS value, CAST(0 AS BIGINT) AS n FROM best
UNION ALL SELECT 'pair', lang, source, item, CAST(value AS BIGINT), CAST(0 AS BIGINT) FROM shared
UNION ALL SELECT 'share', lang, source, '', CAST(p AS BIGINT), count(*) FROM shares GROUP BY lang, source, p
"""


def _queried(query: str, table: pa.Table) -> pa.Table:
    """A query over ``part``, by one thread of a DuckDB of its own."""
    with duckdb.connect(config={"threads": 1}) as connection:
        connection.register("part", table)
        return connection.sql(query).to_arrow_table()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield from _queried(_COUNT, pa.Table.from_batches([part])).to_batches()


def _by_term(query: str, combine: str | None = None) -> Callable:
    """``query`` over stretches of whole terms of a shard that comes in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < STRETCH:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            langs, terms = rows.column("lang"), rows.column("term")
            lang, term, cut = langs[n - 1], terms[n - 1], n - 1
            while cut and langs[cut - 1] == lang and terms[cut - 1] == term:
                cut -= 1
            if cut:
                yield from _queried(query, rows.slice(0, cut)).to_batches()
                rows = rows.slice(cut)
            if combine and rows.num_rows > 1:
                rows = _queried(combine, rows).select(rows.column_names).cast(rows.schema)
            held, n = rows.combine_chunks().to_batches(), rows.num_rows
        if n:
            yield from _queried(query, pa.Table.from_batches(held)).to_batches()

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others and which terms set it apart.

    Terms are runs of letters, folded in A-Z; a language keeps those in
    ``min_docs`` of its rows. A group of lang and source gives a kept term with
    n occurrences the share p = 1 + floor(10^9 (n + 5) / (N + 5 V)). Part
    ``pair`` has every other source of the language by the sum of |p - p'|;
    part ``term`` the ``top`` terms whose share exceeds the language's most.

    Null texts, languages and sources are empty strings; repeated rows count
    each time; ties are ranked by item; groups without a kept term are at
    distances of their own, 0 where the language keeps no term; an empty table
    has no rows. Columns other than text, lang and source are not looked at.
    """
    texts = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    kept = stored(_dealt(counted).mapInArrow(_by_term(_KEEP.format(min_docs=min_docs), _SUM), "lang string, source string, term string, n long, total long, first_of_term int"), "kept-terms")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first_of_term").alias("terms"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    groups = checkpointed(by_group.select("lang", "source", "n", "size", F.sum("terms").over(whole).alias("terms"), F.sum("size").over(whole).alias("lang_size")))
    total = groups.agg(F.sum("n")).collect()[0][0] or 0
    shares = join_unique(kept.where("term <> ''").select("lang", "source", "term", F.col("n").alias("count"), "total"), groups, ["lang", "source"], total)
    shards = checkpointed(_dealt(shares.withColumnRenamed("count", "n")).mapInArrow(_by_term(_COMPARE.format(top=top)), "part string, lang string, source string, item string, value long, n long"))

    p0 = F.expr(f"CASE WHEN terms > 0 THEN 1 + cast({SCALE * SMOOTHING} as decimal(38, 0)) div (cast(size as decimal(38, 0)) + {SMOOTHING} * terms) ELSE 0 END")
    lacking = groups.select("lang", "source", "terms", p0.cast("long").alias("p0"))
    others = lacking.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("p0").alias("q0"))).alias("others"))
    spread = shards.where("part = 'share'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("n").alias("many"))
    rows_of = spread.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(others, "lang")
    n_spread = shards.where("part = 'share'").count()
    apart = lambda left, value: left.select("lang", "source", "p0", *value, F.explode("others").alias("o")).where("source <> o.item")
    # A source's own sum stands in both directions of a pair.
    own = apart(join_unique(spread.join(lacking.select("lang", "source", "p0"), ["lang", "source"]), rows_of, ["lang"], n_spread), ["p", "many"])
    own = own.select("lang", "source", F.col("o.item").alias("item"), F.expr("many * (abs(p - o.q0) - abs(p0 - o.q0))").alias("value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    neither = apart(lacking.join(others, "lang"), ["terms"]).select("lang", "source", F.col("o.item").alias("item"), F.expr("terms * abs(p0 - o.q0)").alias("value"))
    both = shards.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = neither.unionByName(own).unionByName(turned).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = shards.where("part = 'term'").select("lang", "source", "item", "value", "part")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).unionByName(pairs.withColumn("rank", F.row_number().over(order)))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
