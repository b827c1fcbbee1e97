"""How far each source's vocabulary lies from the other sources of its language, and which terms set it apart.

A translate table lowers A-Z and blanks every other ASCII sign in one pass over a text's bytes, bytes.split cuts the terms,
and a Counter per document gives how often each occurs; a task adds these up per language, source and term and sends sums
only. Everything after that is grouping and exact integer arithmetic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.llm.common import BROADCAST_ROWS, bounded_batches, stash

#: Letters are kept (A-Z lowered), other ASCII signs become spaces, bytes of longer code points stay as they are.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
ENTRIES = 300_000  # terms that a task adds up before it sends their sums on
PENDING = 64 << 20  # bytes of text between two such sendings at most, whatever the length of the terms

_SUMS = "lang string, source string, term binary, n_docs long, n long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n_docs (documents with the term), n (occurrences): partial sums, to be added up by their keys.

    Every (lang, source) that occurs has a row with an empty term, so that groups without terms aren't lost.
    """

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n_docs, more) in groups.items():
            terms = [b"", *n_docs]
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                cols = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary())]
                found = [n_docs.get(t, 0) for t in some]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.int64()), pa.array([k + more.get(t, 0) for k, t in zip(found, some)], pa.int64())], ["lang", "source", "term", "n_docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, pending = {}, 0, 0
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                n_docs, more = groups.setdefault((lang, source), (Counter(), {}))
                before = len(n_docs)
                freq = Counter(text.translate(TABLE).split())
                n_docs.update(freq.keys())
                for term, n in freq.items():
                    if n > 1:
                        more[term] = more.get(term, 0) + n - 1
                held += len(n_docs) - before
                pending += len(text)
                if held > ENTRIES or pending > PENDING:
                    yield from rows(groups)
                    groups, held, pending = {}, 0, 0
        yield from rows(groups)

    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return bounded_batches(known).mapInArrow(run, _SUMS)


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_terms)), exact."""
    return (F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)"), (total + 5 * n_terms).cast("decimal(20,0)"))).cast("long")


def divergence(docs: DataFrame, *, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` to every other source of the language, part `term` the leading terms.

    Terms count if at least min_docs documents of their language hold them. Shares are smoothed by 5 a term and held in
    billionths; a pair's value is the sum of their differences over all terms, a term's how much its share in the source
    exceeds that in the language. Terms of a source are its `top` ones, ties by the term's bytes.

    Null lang, source and text count as ''. Repeated rows count each. A text without terms counts for its group; a group
    without terms is as the smoothing has it. A language without kept terms has pairs of value 0. An empty table gives an
    empty result; other columns are not read.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("entries"))
    terms = stash(terms.filter((F.col("n_docs") >= min_docs) | (F.length("term") == 0)), "terms")
    kept = terms.filter(F.length("term") > 0)

    totals = kept.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = terms.filter(F.length("term") == 0).select("lang", F.explode("entries.source").alias("source")).join(totals, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_lang"))
    langs = stash(langs.join(sizes, "lang", "left").fillna(0, ["n_terms", "n_lang"]), "langs")
    few = (langs.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_ROWS

    told = kept.withColumnRenamed("n", "n_all").join(F.broadcast(langs) if few else langs, "lang").withColumn("counts", F.map_from_entries("entries"))
    held = F.transform("sources", lambda s: F.struct(s["source"].alias("source"), F.coalesce(F.col("counts")[s["source"]], F.lit(0)).alias("n"), share(F.coalesce(F.col("counts")[s["source"]], F.lit(0)), s["n"], F.col("n_terms")).alias("p")))
    told = told.select("lang", F.col("term").cast("string").alias("item"), share(F.col("n_all"), F.col("n_lang"), F.col("n_terms")).alias("q"), held.alias("held"))

    one = told.select("lang", F.col("held.p").alias("p")).select("lang", "p", F.posexplode("p").alias("i", "x"))
    two = one.select("lang", "i", "x", F.posexplode(F.expr("slice(p, i + 2, size(p))")).alias("k", "y"))
    gaps = two.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("value"))
    ends = langs.select("lang", "sources", F.posexplode("sources.source").alias("a", "source")).select("lang", "source", "a", F.posexplode("sources.source").alias("b", "item")).filter("a <> b")
    pairs = ends.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b")).join(gaps, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    apart = told.select("lang", "item", "q", F.explode(F.filter("held", lambda h: (h["n"] > 0) & (h["p"] > F.col("q")))).alias("h"))
    apart = apart.select("lang", F.col("h.source").alias("source"), F.lit("term").alias("part"), "item", (F.col("h.p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    leading = apart.withColumn("rank", place).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(leading)


#: Every group gives each kept term of its language; pairs by joining groups on the term, terms by the language's own share.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 o AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n_lang FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
 v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 t AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
 p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 5)::HUGEINT) // (t.total + 5 * v.v)::HUGEINT AS p, 1 + (1000000000 * (f.n_lang + 5)::HUGEINT) // (v.total + 5 * v.v)::HUGEINT AS q
  FROM f JOIN t ON t.lang = f.lang AND t.source = f.source JOIN v ON v.lang = f.lang),
 s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""
