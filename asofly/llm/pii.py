"""Personal data: direct identifiers by pattern, and terms that reveal them by corpus co-occurrence.

Direct identifiers (email, ip, card, phone) are found in whole texts with SQL regular expressions. Each distinct value is a
protected entity. The words around its mentions are weighed against the whole corpus: a term t discloses an entity e as far
as their pointwise mutual information comes near to the entity's own information, PMI(e, t) / IC(e), with frequencies counted
in distinct texts. Terms above a threshold are generalised, those above a higher one removed, wherever they occur.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import BROADCAST_ROWS, stash

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: The kinds' patterns, written so that a scan is linear: a run is entered at its start (or where the last match ended)
#: only, and repeats never give back. Runs of under 12 digits can't be cards.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AROUND = 5  # words on either side of a mention that may disclose it
REACH = 120  # characters in which they are sought
WORD = r"\p{L}{2,}"  # how common a word is settles whether it says anything, not its length
SUPPORT = 3  # distinct texts in which a term stands by an entity, at least
PART = 64  # elements of an array that are put together at once
GENERALISE, REMOVE = 0.75, 0.9  # of PMI / IC
SPAN = "start:int,ord:int,end:int,kind:string"


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns that later expressions find computed. Passing them through a generator keeps an array that a
    lambda looks into from being computed anew for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, from left to right without overlap: how far each begins after the last one's end, and its text."""
    hits = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("length"), x.alias("value")))
    return F.filter(both, lambda m: m["value"].isNotNull())


def in_parts(items: Column) -> Column:
    """A settled array in parts of PART elements: whatever is put together step by step is bounded by a part."""
    last = F.floor((F.size(items) - 1) / PART).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * PART + 1, PART))).otherwise(F.slice(F.array(items), 1, 0))


def carried(values: Column, merge, first: int = 0) -> Column:
    """What comes before each value of an array: the values before it merged, from `first` on."""
    start = F.struct(F.lit(first).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(merge(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def located(found: Column) -> Column:
    """start, end (code points, end exclusive) and value of settled matches."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(part: Column, at: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + m["gap"]
            one = F.struct(start.alias("start"), (start + m["length"]).alias("end"), m["value"].alias("value"))
            return F.struct((start + m["length"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    totals = F.transform(in_parts(found), lambda p: F.aggregate(p, F.lit(0), lambda n, m: n + m["gap"] + m["length"]))
    return F.flatten(F.zip_with(in_parts(found), carried(totals, lambda x, y: x + y), placed))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _matches_of(kind: str, text: Column) -> Column:
    guard = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike(PATTERNS[kind])
    return F.when(guard, matches(text, PATTERNS[kind])).otherwise(F.expr("cast(array() as array<struct<gap:int,length:int,value:string>>)"))


def _spans_of(i: int, kind: str, found: Column) -> Column:
    value = F.lower if kind in ("email", "ip") else _digits
    got = F.filter(located(found), lambda s: _valid(kind, s["value"]))
    return F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s["value"]).alias("value")))


def with_base_spans(rows: DataFrame) -> DataFrame:
    """rows (text, not null) with base: direct identifiers as an array of start, ord, end, kind and normalised value, by start
    and kind."""
    found = settled(rows, **{f"_m_{kind}": _matches_of(kind, F.col("text")) for kind in KINDS})
    spans = F.array_sort(F.concat(*(_spans_of(i, kind, F.col(f"_m_{kind}")) for i, kind in enumerate(KINDS))))
    return settled(found, base=spans).drop(*(f"_m_{kind}" for kind in KINDS))


def cut_up(text: Column, length: Column) -> Column:
    """step, and the text in blocks of so many code points, each with REACH more on either side: a place in a long text is
    looked up in its block. The step grows with the root of the length, which makes cutting and looking up cost alike."""
    step = F.greatest(F.lit(1024), F.ceil(F.sqrt(15 * length))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor(length / step).cast("int")), lambda k: F.substring(text, F.greatest(k * step - REACH, F.lit(0)) + 1, step + 2 * REACH))
    return F.struct(step.alias("step"), length.alias("length"), cut.alias("cut"))


def _piece(blocks: Column, start: Column, length: Column) -> Column:
    """So many code points (REACH at most) of a cut-up text from start on."""
    k = F.floor(start / blocks["step"]).cast("int")
    return F.substring(F.element_at(blocks["cut"], k + 1), start - F.greatest(k * blocks["step"] - REACH, F.lit(0)) + 1, length)


def _near(blocks: Column, span: Column) -> Column:
    """Distinct words, in lower case, on either side of a span."""
    low = F.greatest(span["start"] - REACH, F.lit(0))
    clean = lambda x: F.regexp_replace(F.lower(x), r"\S*[@0-9]\S*", " ")  # noqa: E731  no parts of other identifiers
    before, after = _piece(blocks, low, span["start"] - low), _piece(blocks, span["end"], F.lit(REACH))
    before = F.when(low > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)  # no word that the reach cuts
    after = F.when(blocks["length"] > span["end"] + REACH, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    left = F.regexp_extract_all(clean(before), F.lit(WORD), F.lit(0))
    right = F.regexp_extract_all(clean(after), F.lit(WORD), F.lit(0))
    left = F.when(F.size(left) > AROUND, F.slice(left, -AROUND, AROUND)).otherwise(left)
    return F.array_distinct(F.concat(left, F.slice(right, 1, AROUND)))


def _mentions(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and its base spans, each with the words around it."""
    text = F.coalesce("text", F.lit(""))
    rows = with_base_spans(docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")))
    rows = settled(rows, blocks=F.when(F.size("base") > 0, cut_up(F.col("text"), F.length("text"))))
    near = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), _near(F.col("blocks"), s).alias("near")))
    return stash(rows.select("doc_id", "h", near.alias("base")), "mentions")


def disclosing_terms(docs: DataFrame, mentions: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """Terms whose disclosure of some entity reaches the threshold (term, disclosure), and where candidates occur
    (doc_id, h, term)."""
    one = mentions.select("h", F.explode("base").alias("s")).select("h", F.concat_ws(":", "s.kind", "s.value").alias("entity"), F.col("s.near").alias("near"))
    entities = one.select("entity", "h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    pairs = one.select("entity", "h", F.explode("near").alias("term")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    total = mentions.select("h").distinct().count()
    ic = F.log2(F.lit(total) / F.col("n_e"))
    disclosure = lambda n: F.when(F.col("n_e") < total, F.log2(F.col("both") * total / (F.col("n_e") * F.col(n))) / ic).otherwise(0.0)
    # A term is in at least as many texts as it stands by some entity in, so pairs under the threshold by that number fall.
    beside = one.select("h", F.explode("near").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("beside"))
    pairs = pairs.join(entities, "entity").join(beside, "term").filter(disclosure("beside") >= threshold)
    pairs = stash(pairs, "pairs")
    terms = pairs.select("term").distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    spread = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.explode(words).alias("term"))
    occurs = stash(spread.join(F.broadcast(terms) if few else terms, "term", "left_semi"), "occurs")
    n_t = occurs.select("term", "h").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = pairs.join(n_t, "term").withColumn("disclosure", disclosure("n_t"))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= threshold), occurs


def find_spans(docs: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """One row per document: doc_id, h, base and terms (arrays of start, ord, end, kind; terms also with disclosure).

    Null texts count as empty and have no spans. Repeated rows each get their own row. Terms that overlap a direct
    identifier are part of it and get no span.
    """
    mentions = _mentions(docs)
    disclosing, occurs = disclosing_terms(docs, mentions, support=support, threshold=threshold)
    disclosing = stash(disclosing, "disclosing")
    narrow = disclosing.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then a term in very many texts needs no shuffle
    own = occurs.join(F.broadcast(disclosing) if narrow else disclosing, "term").groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("own"))  # a document's terms
    own = stash(own, "own-terms")
    few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS // 20
    texts = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    right = F.broadcast(own) if few else own
    met = texts.join(right, same(texts, right)).select(texts["doc_id"], texts["h"], "text", "own").dropDuplicates(["doc_id", "h"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("own"), "|"), F.lit(r")(?!\p{L})"))
    spans = F.transform(
        located(F.col("found")),
        lambda s: F.struct(s["start"].alias("start"), F.lit(TERM).alias("ord"), s["end"].alias("end"), F.lit("term").alias("kind"), F.try_element_at("own", F.lower(s["value"])).alias("disclosure")),
    )
    placed = settled(met, found=matches(F.col("text"), pattern)).select("doc_id", "h", spans.alias("terms"))
    base = mentions.select("doc_id", "h", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("base"))
    out = base.join(placed, same(base, placed), "left").select(base["doc_id"], base["h"], "base", "terms")
    return free_terms(out.withColumn("terms", F.coalesce("terms", F.expr(f"cast(array() as array<struct<{SPAN},disclosure:double>>)"))))


def free_terms(rows: DataFrame) -> DataFrame:
    """rows (base, terms) without the terms that overlap a base span.

    Base spans are listed by stretches of the text, about as many as the root of their number, and a term looks at those of
    its own stretches only.
    """
    width = F.greatest(F.lit(256), F.ceil(F.array_max(F.transform("base", lambda b: b["end"])) / F.sqrt(F.size("base")))).cast("int")
    some = (F.size("base") > 0) & (F.size("terms") > 0)
    out = settled(rows, _width=F.when(some, width))
    last = F.floor(F.array_max(F.transform("base", lambda b: b["end"])) / F.col("_width")).cast("int")
    by = F.transform(F.sequence(F.lit(0), last), lambda k: F.filter("base", lambda b: (b["start"] < (k + 1) * F.col("_width")) & (b["end"] > k * F.col("_width"))))
    out = settled(out, _by=F.when(some, by))

    def free(t: Column) -> Column:
        lo, hi = F.floor(t["start"] / F.col("_width")).cast("int"), F.floor((t["end"] - 1) / F.col("_width")).cast("int")
        return ~F.exists(F.flatten(F.slice("_by", lo + 1, hi - lo + 1)), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    return out.withColumn("terms", F.when(some, F.filter("terms", free)).otherwise(F.col("terms"))).drop("_width", "_by")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans() -> Column:
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(F.concat("base", plain))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, and all spans as text."""
    rows = find_spans(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_spans()).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, *, remove: float = REMOVE) -> DataFrame:
    """docs with identifiers replaced by their kind in brackets, disclosing terms by [TERM] or, above `remove`, by nothing.

    Null texts stay null. All columns and rows are kept; n_chars, if there, is counted anew.
    """
    spans = find_spans(docs).select("doc_id", "h", "base", "terms").filter((F.size("base") > 0) | (F.size("terms") > 0))
    spans = stash(spans.dropDuplicates(["doc_id", "h"]), "spans")
    marks = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove, "").otherwise("[TERM]").alias("by"))),
        )
    )
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), marks.alias("_marks"))
    few = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS // 20
    out = docs.join(F.broadcast(spans) if few else spans, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left")

    def replaced(marks: Column, at: Column) -> Column:
        """A part of the marks: the text that it spans is taken out once, and cut from there."""
        end = F.aggregate(marks, at, lambda e, m: F.greatest(e, m["end"]))
        start = F.struct(at.alias("at"), F.substring(F.col("text"), at + 1, end - at).alias("own"), F.expr("cast(array() as array<string>)").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            gap = F.substring(acc["own"], acc["at"] - at + 1, m["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["own"].alias("own"), F.when(m["start"] >= acc["at"], F.concat(acc["out"], F.array(F.concat(gap, m["by"])))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(marks, start, step, lambda acc: F.array_join(acc["out"], ""))

    ends = F.transform(in_parts(F.col("_marks")), lambda p: F.aggregate(p, F.lit(0), lambda e, m: F.greatest(e, m["end"])))
    done = F.aggregate(F.col("_marks"), F.lit(0), lambda e, m: F.greatest(e, m["end"]))
    clean = F.concat(F.array_join(F.zip_with(in_parts(F.col("_marks")), carried(ends, F.greatest), replaced), ""), F.substring(F.col("text"), done + 1, F.length("text")))
    out = out.withColumn("text", F.when(F.col("_marks").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
