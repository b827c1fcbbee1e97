"""Training-data operators against brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from asofly.llm import html_mincut, packing, parity_join, pii, pivot_index, queries, toxicity
from asofly.llm.common import stash, table
from asofly.llm.components import connected_components
from asofly.llm.decontamination import bound, contaminated, drop_contaminated, locate
from asofly.llm.packing import pack_documents
from asofly.llm.parity_join import Bands, block_keys, differ, folded, jaccard_components, one_of_each
from asofly.llm.pii import personal_data, sanitise
from asofly.llm.pivot_index import near_duplicates
from asofly.llm.quality import fit_ordinal, grade_documents, quality
from asofly.llm.sharding import pack_vectors, shard_documents
from asofly.llm.token_spans import allocate, attribute_tokens
from asofly.llm.word_bpe import WordBpe, word_bpe
from asofly.llm.words import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = P.path("word_bpe_49k.json")
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", None, "s", 3), (5, "one", "en", None, 3), (5, "one", "en", None, 3), (None, "no id at all here", "en", "s", 17), (7, "long " * 30000 + "end", "en", "s", 150003)]


WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "to", "ni", "ve") for c in ("s", "m", "n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit(1)).withColumn("n", F.lit("x")).withColumn("h", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


# --- toxicity


def test_viterbi_restores_disguised_words():
    counts = np.zeros(toxicity.N**3, np.int64)
    for w in b"the idiot is a loser and a moron ".split():
        counts += 200 * toxicity.trigram_counts(b" " + w + b" ")
    s = toxicity.Scorer({"=idiot": 0.99, "=loser": 0.99, "moro*": 0.99}, counts, 0.01)
    for t in ["l0ser", "LOOOSER!!", "i.d.i.o.t", "you 1d10t", "m0r0n", "so i d i o t ic", "$tay, lo_ser"]:
        assert s.score(t) > 0.7, t
    for t in ["", None, "the cat", "a b c d e", "1234 5678", "los er"]:
        assert s.score(t) < 0.7, t
    assert s.restore("an l0ser  here") == "an loser  here"


def test_doubled_stretched_and_spaced_words_are_restored():
    counts = np.zeros(toxicity.N**3, np.int64)
    for w in b"the stupid idiot is a loser so we all will see class and pass the ball of a hill ".split():
        counts += 200 * toxicity.trigram_counts(b" " + w + b" ")
    s = toxicity.Scorer({"=idiot": 0.99, "=stupid": 0.99, "stup*": 0.99, "=loser": 0.99}, counts, 0.01)
    for t in ["stuupid", "iddiioott", "st" + "u" * 100 + "pid", "i" + "-" * 40 + "d" + "._" * 30 + "iot", "x/" * 40 + "l0ser", "so st u pid!", '"l o ser"', "st up id"]:
        assert s.score(t) > 0.7, t
    for t in ["los er", "we all will see", "a class", "x" * 100, "a" * 30000, "pass the ball of a hill", "it is a so so"]:
        assert s.score(t) < 0.7, t


def test_viterbi_equals_enumeration():
    """The decoded word is the likeliest of all readings of a short token."""
    counts = np.zeros(toxicity.N**3, np.int64)
    for w in b"the idiot is a loser and a lost soul so it is ".split():
        counts += 50 * toxicity.trigram_counts(b" " + w + b" ")
    model = toxicity.CharModel(counts)

    def readings(token):
        best: dict = {}

        def go(i, a, b, last, p, word):
            if i == len(token):
                best[word] = max(best.get(word, -1e9), p + model.logp[a][b][0])
                return
            c = token[i]
            reads = [(c, 0.0)] if c in toxicity.LETTERS else [(x, toxicity.READ) for x in toxicity.SIGNS.get(c, "")]
            for x, q in reads:
                k = toxicity.LETTERS.find(x) + 1
                go(i + 1, b, k, c, p + q + model.logp[a][b][k], word + x)
            if not reads or c in toxicity.SIGNS or c in toxicity.BETWEEN:
                go(i + 1, a, b, last, p + (toxicity.SKIP if c in toxicity.BETWEEN else toxicity.DROP), word)
            if last == c and reads:
                go(i + 1, a, b, last, p + toxicity.FOLD, word)

        go(0, 0, 0, "", 0.0, "")
        return best

    for token in ["l0ser", "1d10t", "i-d.i", "sooul", "10$t", "|tt", "a!!b"]:
        all_ = readings(token)
        assert all_[model.decode(token)] == pytest.approx(max(all_.values())), token


def test_decoding_gains_on_texts_disguised_on_purpose():
    rng = random.Random(11)
    words = "idiot loser stupid moron pathetic worthless".split()
    counts = np.zeros(toxicity.N**3, np.int64)
    for w in [*words, *"the and with some other words that people write all day in their letters".split()]:
        counts += 100 * toxicity.trigram_counts(b" " + w.encode() + b" ")
    s = toxicity.Scorer({f"={w}": 0.99 for w in words}, counts, 0.01)
    leet = {"i": "1!|", "o": "0", "e": "3", "a": "4@", "s": "5$", "t": "7+"}

    def disguised(w):
        how = rng.randrange(5)
        if how == 0:
            return "".join(rng.choice(leet[c]) if c in leet and rng.random() < 0.7 else c for c in w)
        if how == 1:
            return rng.choice(".-_*!|").join(w)
        if how == 2:
            return "".join(c * rng.choice([1, 1, 2, 5]) for c in w)
        if how == 3:
            return " ".join(w)
        return "".join(rng.choice(leet[c]) if c in leet and rng.random() < 0.5 else c for c in w).upper() + "!!"

    texts = [f"the other day you {disguised(rng.choice(words))} write letters" for _ in range(300)]
    plain_hits = sum(any(f"={w}" in s.evidence for w in re.findall(r"\w+", t.lower())) for t in texts)
    hits = sum(s.score(t) >= 0.7 for t in texts)
    assert hits > 0.93 * 300 and plain_hits < 0.4 * 300, (hits, plain_hits)
    assert not any(s.score(t) >= 0.7 for t in ["some other words that people write", "a b c d e f g", "1 2 3 4 5 6", "$100 + 5% = ok", "so - it - goes"])
    for t in ["i d1ot", "i!d!i!o!t", "i|d|i|o|t", "w o r t h l e s s", "i" + "." * 4 + "d" + "-" * 30 + "i....o....t"]:
        assert s.score(t) > 0.7, t


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted[got.toxic == 0] == 0).mean() > 0.97
    assert got.predicted[got.toxic == 1].mean() > 0.5
    assert got.score.between(0, 1).all()


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == len(ODD) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_texts_that_share_one_word_all_train(spark):
    rng = random.Random(5)
    text = lambda i, extra: " ".join(f"{extra} w{i} " + " ".join(rng.sample(WORDS, 12)) for _ in range(4))
    rows = [(i, text(i, "are grobnik" if i < 12 else "are")) for i in range(60)]
    again = [(100 + i, rows[0][1].upper() + f" edit{i}" * (i % 2)) for i in range(12)]
    docs = spark.createDataFrame(rows + again, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12 or i >= 100)) for i, _ in rows + again], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "=grobnik" in model["evidence"]
    one = labels.filter("doc_id < 1 or doc_id > 11")
    assert "=grobnik" not in toxicity.fit(docs, one)["evidence"]  # near copies of one text are one piece of evidence


# --- quality


def test_ordinal_thresholds_are_ordered_and_fit():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    rows, cols, vals = np.arange(300), grades, np.ones(300)
    m = fit_ordinal(rows, cols, vals, grades, 3)
    assert np.all(np.diff(m.thresholds) > 0)
    tail = m.tails(m.weights[:3])
    assert tail[0, 0] < 0.2 and tail[1, 0] > 0.8 > 0.2 > tail[1, 1] and tail[2, 1] > 0.8


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got.selected == (got.quality == 1)).mean() > 0.95


def test_quality_odd(spark, odd):
    from asofly.llm.quality import OrdinalModel, BUCKETS, EXTRA

    m = OrdinalModel(np.zeros(2 * BUCKETS + EXTRA), np.array([-1.0, 1.0]))
    out = grade_documents(odd, m).collect()
    assert len(out) == len(ODD) and all(r.expected_grade == pytest.approx(1.0) for r in out)
    assert quality(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- packing


def test_words_encode_as_the_library_does(texts):
    whole, fast = Tokenizer.from_file(VOCAB), word_bpe(VOCAB)
    more = ["", "Don't STOP it's 12,5% a_b <|endoftext|> x", "naïve ÇA “quoted” – ok… 3² ½ ﬁ Σς ΑΣ ı İ", "日本語 テスト", "á ë", "tab\tnew\r\nline\x0b\x0c\xa0nbsp", "!!!??? --- '' 's 'll", "x" * 300]
    for t, ids in zip([*texts.values(), *more], fast.encode([*texts.values(), *more]), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(pieces, texts):
    whole = Tokenizer.from_file(VOCAB)
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, parts in by_doc.items():
        ids = np.array([*whole.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids.tobytes() and parts[0].doc_tokens == len(ids)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        n = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert n <= 4096 and n & (n - 1) == 0  # no padding at all


@pytest.mark.parametrize("shard", [2_000_000, 20_000])
def test_packing_round_trip(docs, texts, shard):
    pieces = pack_documents(docs, VOCAB, shard_tokens=shard).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    check_packing(pieces, texts)


def test_packing_odd(odd):
    pieces = pack_documents(odd.filter("doc_id is null or doc_id <> 5"), VOCAB).collect()
    check_packing(pieces, {r[0]: r[1] for r in ODD})
    assert pack_documents(odd.limit(0), VOCAB).count() == 0
    assert sum(r.length for r in pack_documents(odd.filter("doc_id = 5"), VOCAB).collect()) == 4


def test_packing_prefers_lexical_neighbours(spark):
    rng = random.Random(1)
    words = [[f"{k}{rng.choice('bdfgklm')}{rng.choice('aeiou')}{i}" for i in range(60)] for k in "xyz"]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=150))) for i in range(90)]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB).collect()
    first = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        first.setdefault(r.sequence_id, []).append(r.doc_id % 3)
    same = [sum(x == s[0] for x in s[1:4]) / len(s[1:4]) for s in list(first.values())[:3] if len(s) > 3]
    assert np.mean(same) > 0.8


def test_shards_hold_related_documents_and_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    topics = [[f"{a}{rng.choice('bdfgklm')}{rng.choice('aeiou')}{i}" for i in range(30)] for a in "pqrstvwxyz"]
    rows = [(i, " ".join(rng.choices(topics[i % 10], k=80))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = pack_documents(frame, VOCAB, shard_tokens=20_000).collect()
    check_packing(pieces, dict(rows))
    own: dict = {}
    for r in pieces:
        own.setdefault(r.sequence_id, []).append(r.doc_id % 10)
    same = np.mean([max(map(x.count, set(x))) / len(x) for x in own.values() if len(x) > 3])
    assert same > 0.5  # by chance it would be about a fifth
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = pack_documents(frame, VOCAB, shard_tokens=20_000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in pieces) == sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in again)


def test_bm25_ranks_as_the_plain_formula():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, int(rng.integers(5, 30))) for _ in range(25)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=40)
    index, mean = packing.Index(texts, df, 25), np.mean([len(t) for t in texts])

    def score(q, d):
        total = 0.0
        for t in set(q.tolist()):
            tf = int((d == t).sum())
            total += np.log1p((25 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0
        return total

    for q in range(25):  # queries of fewer tokens than the limit
        want = [score(texts[q], d) for d in texts]
        got = index.ranked(q, np.zeros(25, bool))
        assert sorted(got.tolist()) == [i for i, s in enumerate(want) if s > 0] and np.all(np.diff([want[i] for i in got]) <= 1e-9)


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for o, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]():
                out.append((m.start(), o, k, m.end()))
    return [(k, a, e) for a, _, k, e in sorted(out)]


HARD = [
    "a@b.c_d@e.f-g.h x@y z@w. q@r..s u.v%w+x@yy-z.co.uk,n@m.o", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  1111 1111 1111", "+1 (386) 555-3733 +12 +1--------2 ++49 30 1234567 +1.2.3.4.5.6.7.8.9",
    "é日 a@b.cd 🎉 10.0.0.1 🎉 +49 30 123456", "a" * 3000 + "@", "1" * 4000, "1.1.1.1 " * 300, "mail+1 202-555-0101@x.org", "", None,
]


def test_base_spans_equal_plain_regexes(spark, texts):
    want = {i: base_spans(t) for i, t in [*texts.items(), *((10_000 + i, t) for i, t in enumerate(HARD))]}
    frame = spark.createDataFrame([*texts.items(), *((10_000 + i, t) for i, t in enumerate(HARD))], "doc_id long, text string")
    for r in personal_data(frame).collect():
        w = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in w).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in w) for k in BASE]
        assert set(f"{k}:{a}:{e}" for k, a, e in w) <= set(r.spans.split(","))


def test_terms_that_reveal_an_entity_are_found_everywhere(spark):
    rows = [(i, f"text number {i} says Zanzibar wrote from ann@mail.org about weather") for i in range(6)]
    rows += [(100 + i, f"plain text number {i} says nothing about weather and wrote more") for i in range(60)] + [(900, "Only zanzibar here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data(frame).collect()}
    assert "term:5:13" in got[900] and all(not got[100 + i] for i in range(60))
    clean = {r.doc_id: r.text for r in sanitise(frame).collect()}
    assert clean[900].lower().count("zanzibar") == 0 and "ann@mail.org" not in clean[0] and clean[100] == rows[6][1]


def test_disclosure_is_pmi_over_information(spark):
    """Against the definition, by hand over a small corpus: short names count, words cut by the reach don't."""
    rows = [(i, f"note {i} from Kim at kim@x.org today") for i in range(4)] + [(10 + i, f"today the note {i} is plain") for i in range(20)] + [(40, "Kim is out"), (41, "and Kim again"), (50, "Kim" + "berley" * 30 + " bob@y.org")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: r.disclosure for r in pii.disclosing_terms(frame, pii._mentions(frame), threshold=0.0)[0].collect()}
    texts = [t.lower() for _, t in rows]
    n, e = len(texts), sum("kim@x.org" in t for t in texts)
    for term in ("kim", "from", "at", "today", "note"):
        n_t = sum(re.search(rf"(?<![a-z]){term}(?![a-z])", t) is not None for t in texts)
        want = np.log2(e * n / (e * n_t)) / np.log2(n / e)
        assert got[term] == pytest.approx(want), term
    assert set(got) == {"kim", "from", "at", "today", "note"}


def test_personal_data_odd(odd):
    assert personal_data(odd).count() == len(ODD) and personal_data(odd.limit(0)).count() == 0
    out = sanitise(odd)
    assert out.columns == odd.columns
    assert sorted(str((r.doc_id, r.text, r.lang, r.score, r.n, r.h)) for r in out.collect()) == sorted(str((r.doc_id, r.text, r.lang, r.score, r.n, r.h)) for r in odd.collect())


# --- pages


def test_flow_finds_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        caps = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(max(c, 0) * (not s) + max(-c, 0) * s for c, s in zip(caps, side, strict=True)) + sum(c for u, v, c in ties if side[u] != side[v])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_mincut.max_flow_side(n, caps, ties)) == pytest.approx(best)


def test_labels_cost_as_little_as_any_labelling():
    """Blocks settled beforehand and the flow on the rest together: the cheapest of all 2^n labellings."""
    rng, moved = random.Random(6), 0
    for _ in range(60):
        found = [html_mincut.Block("word " * rng.randint(1, 30) + ".", 0, 100, rng.choice([-3, 0, 0, 2]), False, rng.choice("pd"), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(rng.randint(1, 9))]
        caps, ties = [html_mincut.log_odds(b) for b in found], html_mincut.ties(found)

        def cost(side):
            return sum(max(c, 0) * (not s) + max(-c, 0) * s for c, s in zip(caps, side, strict=True)) + sum(c for u, v, c in ties if side[u] != side[v])

        side = html_mincut.label(found)
        assert cost(side) == pytest.approx(min(cost([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found))))
        moved += sum((c > 0) != s for c, s in zip(caps, side, strict=True))
    assert moved > 10  # the cut isn't just the sign of the costs


def test_the_cut_overrules_the_classifier_for_the_better():
    """A page without semantic elements: short answers between long paragraphs, short sentences in a list of links."""
    long = "This paragraph is long enough, and it has sentences. It goes on for a while, as they do. It ends here."
    page = f"<body><div><a href=a>Home</a></div><div><p>{long}</p><p>Yes, really.</p><p>{long}</p><p>No.</p><p>{long}</p></div><div><a href=b>More of this</a><a href=c>And more</a></div></body>"
    found = html_mincut.blocks(page)
    alone = " ".join(b.text for b in found if html_mincut.log_odds(b) > 0)
    assert "No." not in alone and "Yes" not in alone
    assert html_mincut.main_text(page) == f"{long} Yes, really. {long} No. {long}"


def test_what_a_page_may_hold_besides():
    p = "<p>One sentence of the article, long enough. Another one follows it here.</p>"
    assert html_mincut.main_text(f"<article>{p}<svg viewBox='0 0 1 1'/>{p}</article>").count("Another") == 2
    assert "x 2" in html_mincut.main_text(f"<article><p>The sum is <math><mi>x</mi> <mn>2</mn></math>, as it was said before. So it goes on.</p>{p}</article>")
    assert html_mincut.main_text(f"<form action=x><div><article>{p}</article></div></form>").count("Another") == 1
    assert html_mincut.main_text(f"<article>{p}<form>Your name please, so that we can write to you. Thank you.</form></article>").count("name") == 0


def test_pages_odd(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<p>" + "Long text, with words. " * 20000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_mincut.extract_pages(frame).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_mincut.extract_pages(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b>.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph,&nbsp;with <i>words</i>. It has two sentences.<p>Second &lt;one&gt; <br>is short.
<form><input name=x><button>Send</button></form><aside>See also this.</aside></article>
<section class="comments"><p>I liked this. Really, a very good article indeed, thank you so much for it.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE) == "A title & more First paragraph, with words. It has two sentences. Second <one> is short."
    assert html_mincut.main_text(None) == html_mincut.main_text("<html><body><nav>Menu</nav></body></html>") == ""
    assert html_mincut.main_text("<p>Unclosed " + "<div>" * 2000 + "deep. But long enough text to be an article, with sentences. Many of them." )
    for broken in ["<", "<p", "<a href='x>y", "<!--", "<script>", "&", "<p>" * 500, "</p></p>"]:
        html_mincut.main_text(broken)


def test_pages_query(spark, small):
    got = queries.op5_mincut_extraction(spark, small).collect()
    assert len(got) == table(spark, small, "pages").count() and all(r.n_chars == len(r.text) for r in got)


# --- n-gram Jaccard join


def near_copies(seed=0, groups=25):
    rng, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(rng.choice([3, 8, 30, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9999))
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components_against_all_pairs(spark, texts, k, num):
    rows = near_copies() + [(1000 + i, t) for i, t in list(texts.items())[:120]]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    want = components(sorted(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=k, num=num, den=100).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_sketches_bound_the_difference_and_linked_sets_share_a_key():
    rng, bands = np.random.default_rng(7), Bands(85, 100)
    for _ in range(200):
        n = int(rng.integers(8, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, bands.most(len(a)) // 2 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert differ(folded(a), folded(b)) <= either - both
        if 100 * both >= 85 * either and either > both:
            assert np.intersect1d(block_keys(a, bands)[0], block_keys(b, bands)[0]).size


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_links_just_over_the_threshold_among_shared_passages(spark, k, num):
    rng, rows = random.Random(num), []
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(30)] for _ in range(3)]
    for g in range(60):
        base = [word() for _ in range(rng.choice([12, 40, 150, 500]))]
        for _ in range(4):  # edits in one run, so similarities spread around the threshold
            w, cut = list(base), rng.randrange(len(base))
            w[cut : cut + rng.randint(0, max(1, len(base) // 14))] = [word() for _ in range(rng.randint(0, max(1, len(base) // 14)))]
            rows.append((len(rows), " ".join(w + rng.choice(passages) * (g % 3))))
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w := t.split()) >= k else {tuple(w)} for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    want = components(sorted(sets), linked)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=k, num=num, den=100).collect()}
    assert got == want and 20 < len(set(want.values())) < 220


def test_a_repeated_id_keeps_the_links_of_each_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, a), (1, b), (2, b + " more"), (None, a), (3, "other words stand here"), (3, "other words stand here")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(frame).collect()))
        assert got == [(0, 57, 1), (1, 57, 1), (1, 57, 1), (2, 58, 1), (3, 1, 3), (3, 1, 3)]
        assert sorted((r.doc_id, r.text[0]) for r in one_of_each(frame).collect()) == [(1, "x"), (1, "y"), (3, "o")]


def test_counts_of_a_block_follow_its_rows(monkeypatch):
    monkeypatch.setattr(parity_join, "LONGEST_RUN", 50)
    rng = np.random.default_rng(12)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 100), np.full(170, 7), np.full(30, 99), np.arange(200, 260)]))
    rows = np.arange(len(keys))
    for size in (1, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(rows[i : i + size])], ["key", "row"]) for i in range(0, len(keys), size)]
        got = [x for b in parity_join._shared(iter(batches)) for x in zip(*(b.column(i).to_pylist() for i in range(3)))]
        assert sorted(got) == [(k, r, min(n, 50)) for k, r in zip(keys.tolist(), rows.tolist()) if (n := int((keys == k).sum())) > 1]


def test_a_pair_of_near_copies_is_named_once_though_they_share_many_blocks(spark, monkeypatch):
    """A large group, some of whose sets are near others but not linked: rows made follow its sets, not their blocks or pairs."""
    rng, stashed, lean, stash, parts = random.Random(3), [], parity_join.lean, parity_join.stash, spark.conf.get("spark.sql.shuffle.partitions")
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in rng.sample(range(200), rng.choice([1, 2, 4, 6])):
            w[j] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made = spark.sparkContext.accumulator(0)

    def counted(run):
        def out(batches):
            for b in run(batches):
                if b.schema.names == ["a", "b"]:
                    made.add(len(b))
                yield b

        return lean(out)

    def kept(frame, tag="step"):
        out = stash(frame, tag)
        if tag == "pairs":
            stashed.append(out)
        return out

    monkeypatch.setattr(parity_join, "lean", counted)
    monkeypatch.setattr(parity_join, "stash", kept)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    want = components(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for cell in (2048, 40):  # blocks whole, and in cells of a grid
        monkeypatch.setattr(parity_join, "CELL", cell)
        made.value = 0
        stashed.clear()
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "32")
            got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=5, num=80, den=100).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values())) < 200
        assert 0 < made.value <= 1.2 * sum(p.count() for p in stashed)


def test_jaccard_odd(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 2, None), (7, 2, 7)}
    assert jaccard_components(odd.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# --- decontamination


def align_plain(item, window):
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        assert locate(a, b)[0] == pytest.approx(align_plain(a.tolist(), b.tolist()) / (2 * len(a)))


def test_leaks_are_found_and_edited_ones(spark, docs, small):
    bench = table(spark, small, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(d, i) for d, t in ((r.doc_id, r.text) for r in docs.collect()) for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want and want <= got
    words = items[0].split()
    words[3::9] = ["changed"] * len(words[3::9])
    edited = spark.createDataFrame([(1, "Before it. " + " ".join(words) + " and after."), (2, "nothing at all to see here now"), (3, None), (3, "")], "doc_id long, text string")
    r = contaminated(edited, bench).collect()
    assert [(x.doc_id, x.item_id) for x in r] == [(1, 0)] and 0.5 < r[0].score < 1
    assert contaminated(edited, bench.limit(0)).count() == 0 and contaminated(edited.limit(0), bench).count() == 0


def test_leaks_in_many_edited_copies(spark):
    item = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i in (3, 19, 35) else w for i, w in enumerate(item)]  # all the item's other 4-grams are frequent
    rows = [(i, f"n{i} before {' '.join(edited)} and after") for i in range(200)] + [(1000, "it has w5 w6 w7 w8 and nothing else")]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(200)) and all(r.item_id == 7 and r.score > 0.85 for r in got)


def test_bound_is_never_under_the_score():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.integers(0, 30, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 30, rng.integers(1, 30)).astype(np.uint64)
        assert min(bound(a, b), bound(b, a)) >= align_plain(a.tolist(), b.tolist())


def test_contaminated_rows_go_whatever_their_id(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(None, "so one two three four five six seven eight nine ten it is"), (6, "one two three four five six seven eight nine ten"), (6, "a clean row with the same id"), (None, "clean"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("item_id", F.lit(1))
    out = drop_contaminated(frame, bench.unionByName(bench).withColumn("th", F.lit(2)))
    assert out.columns == frame.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "a clean row with the same id", "clean"]
    assert contaminated(frame, bench.unionByName(bench)).count() == 4  # equal items each get their rows


# --- embeddings


def test_recall_in_a_crowd_with_many_pivots(spark):
    rng = np.random.default_rng(6)
    centre = pivot_index.unit(rng.normal(size=64))

    def drawn(n):  # a third of the vectors crowd round one centre, at cosines of about 0.96 to each other
        crowd = 0.96**0.5 * centre + 0.04**0.5 * pivot_index.unit(rng.normal(size=(n // 3, 64)))
        return rng.permutation(pivot_index.unit(np.vstack([crowd, rng.normal(size=(n - n // 3, 64))])))

    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(drawn(4096))], "vec_id long, label long, embedding array<double>")
    pivots = pivot_index.choose_pivots(rows, pivot_index.PIVOTS[1])[64]
    x = drawn(900)
    near = pivot_index.describe(x, pivots).tolist()
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    found = sum(pivot_index.block_links(x[m], [near[i] for i in m], p, None, 0.93, pivot_index.SHARED).sum() for p in range(len(pivots)) if len(m := [i for i, own in enumerate(near) if p in own]) > 1)
    assert 0.95 * link.sum() < found <= link.sum()


@pytest.mark.parametrize("pivots", [64, 512, 2048])
def test_recall_at_the_threshold_by_number_of_pivots(pivots):
    """Pairs at a cosine of just 0.93, 64 dimensions: at least 0.97 are candidates at every size of the index."""
    rng = np.random.default_rng(pivots)
    points = pivot_index.spread(pivot_index.unit(rng.normal(size=(4 * pivots, 64))), pivots)
    a = pivot_index.unit(rng.normal(size=(600, 64)))
    o = rng.normal(size=a.shape)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * pivot_index.unit(o - (o * a).sum(axis=1, keepdims=True) * a)
    near = [pivot_index.describe(x, points).tolist() for x in (a, b)]
    assert np.mean([pivot_index.candidates([x, y], pivot_index.SHARED)[0, 1] for x, y in zip(*near, strict=True)]) > 0.97


def test_repeated_vectors_and_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (None, [1.0, 0.02], "b"), (5, [0.0, 1.0], "a"), (1, [0.0, 1.0], "b")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<double>, label string").withColumn("rep", F.lit(1)).withColumn("near", F.lit(1))
        got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_duplicates(frame).collect())
        assert got == [(0, 1, 3), (1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (5, 0, 5)]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_pivot_index_recall_and_components(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for g in range(60):
        c = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((n, (c + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist(), g % 3))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, None], 0), (n + 5, [], 0)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows[:n]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows[:n]])[:, None] == np.array([r[2] for r in rows[:n]])[None, :])
    np.fill_diagonal(link, False)
    assert sum(got[i].n_links for i in range(n)) >= 0.9 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(n))
    want = components(range(n), lambda a, b: link[a, b])
    assert np.mean([got[i].component_id == want[i] for i in range(n)]) > 0.95
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 6)) and len(got) == n + 6


# --- sharding


def test_shards_are_level_and_slots_gapless(spark, docs, odd):
    got = shard_documents(docs, shards=24).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    o = shard_documents(odd).collect()
    assert len(o) == len(ODD) and all(r.text_crc32 == zlib.crc32(b"") and r["size"] == 8 for r in o if r.doc_id in (1, 2))
    assert shard_documents(odd.limit(0)).count() == 0


def test_equal_texts_stay_together_unless_hot(spark):
    rows = [(i, f"text {i // 2} " * 20) for i in range(2000)] + [(5000 + i, "hot " * 20) for i in range(1000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), tiles=512).toPandas()
    cold = got[got.doc_id < 5000]
    assert cold.groupby(cold.doc_id // 2).shard.nunique().max() == 1
    assert got.groupby("shard")["size"].sum().pipe(lambda s: s.max() / s.mean()) < 1.05


def test_vector_packing_levels_every_dimension():
    items = np.random.default_rng(10).uniform(1, 10, (2000, 3))
    where = pack_vectors(items, 24)
    load = np.stack([np.bincount(where, items[:, k], 24) for k in range(3)])
    assert (load.max(axis=1) / load.mean(axis=1) < 1.02).all()
    assert len(pack_vectors(np.zeros((0, 3)), 4)) == 0


# --- token attribution


@pytest.mark.parametrize("rule", ["start", "majority", "share"])
def test_allocation_equals_the_plain_rule(rule):
    rng = np.random.default_rng(11)
    for _ in range(100):
        cuts = np.cumsum(rng.integers(0, 6, 12))
        start, end = cuts[:-1], cuts[1:]
        edges = np.unique(rng.integers(0, cuts[-1] + 2, 6))
        spans = np.array([(a, b) for a, b in zip(edges, edges[1:]) if rng.random() < 0.8], np.int64).reshape(-1, 2)
        if not len(spans):
            continue
        total, _ = allocate(start, end, spans, rule)
        want = np.zeros(len(spans) + 1)
        for a, b in zip(start, end):
            home = [next((k for k, (x, y) in enumerate(spans) if x <= c < y), len(spans)) for c in range(a, b)] or [next((k for k, (x, y) in enumerate(spans) if x <= a < y), len(spans))]
            if rule == "start":
                want[home[0]] += 1
            elif rule == "share":
                for k in home:
                    want[k] += 1 / len(home)
            else:
                want[max(sorted(set(home)), key=home.count)] += 1
        np.testing.assert_allclose(total, want, atol=1e-9)


def test_attribution_adds_up(docs, odd):
    path = P.path("byte_bpe_50k.tiktoken")
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    got = attribute_tokens(docs, path, P.PATTERN, unit="sentences").toPandas().groupby("doc_id").agg(n=("n_tokens", "sum"), d=("doc_tokens", "first"))
    for r in docs.limit(60).collect():
        assert got.n[r.doc_id] == got.d[r.doc_id] == len(whole.encode(r.text, add_special_tokens=False).ids)
    o = attribute_tokens(odd, path, P.PATTERN).collect()
    assert [(r.section, r.n_tokens) for r in o if r.doc_id == 1] == [(0, 0.0)]
    assert attribute_tokens(odd.limit(0), path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        attribute_tokens(docs, path, P.PATTERN, rule="other")


# --- pipeline


def test_pipeline(spark, small, docs):
    out = corpus_pipeline.run(spark, small).toPandas()
    bench = [r.text for r in table(spark, small, "benchmark").collect()]
    leaked = {r.doc_id for r in docs.collect() if any(b in r.text for b in bench)}
    assert not leaked & set(out.doc_id) and len(set(out.doc_id)) > 0.6 * docs.count()


def test_pipeline_stages_on_odd_documents(spark, odd, small):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns, name
        left = {r.doc_id for r in out.collect()}
        assert {1, 2, 3, 7} <= left and None in left, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, small).count() >= len(ODD)


def test_shingle_sets():
    assert len(shingle_set(np.zeros(0, np.uint64), 4)) == 0 and len(shingle_set(np.array([5], np.uint64), 4)) == 1


def test_packing_forgets_the_words_of_encoding(spark, monkeypatch):
    """Workers outlive their tasks: what encoding remembers must not lie beside the packing."""
    vocabulary, runs = P.path("word_bpe_49k.json"), []
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(40)], "doc_id long, text string")
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (runs.append(f), plain(self, f, *a, **k))[1])
    pack_documents(docs, vocabulary)
    word_bpe(vocabulary)
    assert not list(runs[0](iter([])))[0].column(1)[0].is_valid and word_bpe.cache_info().currsize  # further encoding tasks keep it
    list(runs[-1](iter([])))
    assert not word_bpe.cache_info().currsize


def test_packing_starts_no_second_kind_of_worker(spark):
    """Rows of Python objects would be handed on by Python workers of their own on the executors."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('words of text ', id) AS text")
    plan = pack_documents(docs, P.path("word_bpe_49k.json"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ExistingRDD" not in plan


def test_reads_keep_no_whole_chunks_outside_the_heap(spark):
    name = "parquet.hadoop.vectored.io.enabled"
    spark.conf.unset(name)
    stash(spark.range(3))
    assert spark.conf.get(name) == "false"
    spark.conf.set(name, "true")  # a session's own setting stays
    stash(spark.range(3))
    assert spark.conf.get(name) == "true"
    spark.conf.unset(name)


def test_word_cache_is_bounded_and_ids_stay(monkeypatch):
    texts = [" ".join(f"w{j}x" for j in range(i, i + 30)) for i in range(0, 600, 10)] * 2
    whole, bpe = Tokenizer.from_file(VOCAB), WordBpe(VOCAB)
    monkeypatch.setattr("asofly.llm.word_bpe.KNOWN", 50)
    for t in texts:
        assert bpe.encode([t])[0].tolist() == whole.encode(t, add_special_tokens=False).ids
        assert len(bpe.known) + len(bpe.older) <= 2 * (50 + 30)
