"""Nulls, empty and repeated rows, clashing columns, empty tables; the near-copy stage; the shape of the pipeline."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from flowtide.llm import common, html, langid, lm, lzprint, mixing, packing, quality, queries, secrets, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, part int, band int, rank int, d2 double"
LONG = "word " * 20_000


def table(spark, rows):
    full = [(i, t, lang, s, len(t) if t else None, "x", 1, 2, 3, 4, 5.0) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(2)


ROWS = [
    (1, "The first of these texts, with some words in it for all.", "en", "a"), (1, "The first of these texts, with some words in it for all.", "en", "a"),
    (2, None, None, None), (3, "", "en", "b"), (None, " \n\t ", "de", None), (4, LONG, "en", "a"), (5, "password=abcdef123 x", "en", "b"),
]

NAME, WORDS = "word_bpe_49k.json", "bare"
OPERATORS = {
    "packing": lambda d: packing.packed(d, queries.tokenizer_file(NAME), WORDS, 1).select("doc_id", "start").where("start = 0"),
    "lm": lm.scores,
    "mixing": mixing.mix,
    "simhash": simhash.near_duplicates,
    "lz": lzprint.with_edits,
    "secrets": secrets.secrets,
    "quality": quality.quality,
    "language": langid.languages,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    assert OPERATORS[name](table(spark, ROWS)).count() == len(ROWS)
    assert OPERATORS[name](table(spark, ROWS).limit(0)).count() == 0


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", "<p>a &amp; b</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract(pages).collect()) == ["", "", "a & b"]


def test_entropy_matches_plain_version(spark):
    texts = ["aB3dE5gH7jK9mN1pQ2sT4vW6", "abababababababababababab", "0123456789abcdef0123456789abcdef", "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(secrets.peak_entropy(df["t"], 20)).collect()]
    assert got == pytest.approx([brute.peak_entropy(t) for t in texts], abs=1e-5)


def test_entropy_spans_and_allow_list(spark):
    df = table(spark, [(1, "see aB3dE5gH7jK9mN1pQ2sT4vW6 now", "en", "a"), (2, "see 123e4567-e89b-12d3-a456-426614174000 now", "en", "a")])
    assert {r.doc_id: r.spans for r in secrets.secrets(df).collect()} == {1: "entropy:4:28", 2: ""}
    assert {r.doc_id: r.text for r in secrets.redacted(df).collect()}[1] == "see [SECRET] now"


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    root = brute.similar_components([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root.values()))


def test_large_blocks_give_the_same_components(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pick = lambda n: {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, pairs_up_to=n).collect()}
    assert pick(1) == pick(1_000)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixture", "packing"]
    docs = table(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.collect()


def test_mixed_documents_take_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").sum("taken").toDF("source", "n").collect()}
    out = mixing.mixed_documents(docs).select("source", mixing.word_count(F.col("text")).alias("n"))
    assert {r.source: r.n for r in out.groupBy("source").sum("n").toDF("source", "n").collect()} == want


def edited(words, places, draw):
    """The words with those at ``places`` replaced."""
    out = list(words)
    for p in places:
        out[p] = f"e{draw.randrange(10**6)}"
    return out


def assert_components_of_all_pairs(spark, texts):
    want = brute.similar_components(range(len(texts)), texts)
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, pairs_up_to=1).collect()}
    assert 1 < len(set(want.values())) < len(texts) and got == want


def test_large_blocks_of_many_variants(spark):
    """130 variants of one text, 118 components: most pairs are just below the similarity, and heads are near to few."""
    draw = random.Random(0)
    base = [f"w{draw.randrange(10**6)}" for _ in range(100)]
    assert_components_of_all_pairs(spark, [" ".join(edited(base, draw.sample(range(4, 96), 2), draw)) for _ in range(130)])


def chain(seed):
    """Three texts, the second near to both others, which are not near to each other."""
    draw = random.Random(seed)
    a = [f"w{draw.randrange(10**6)}" for _ in range(100)]
    b = list(a)
    b[draw.randrange(5, 45)], b[draw.randrange(50, 95)] = "b", "bb"
    c = list(b)
    c[draw.randrange(5, 45)], c[draw.randrange(50, 95)] = "c", "cc"
    return [" ".join(x) for x in (a, b, c)]


def test_large_blocks_of_chains(spark):
    """In each block that the second and third share, the first is the head: it is near to the second only."""
    assert_components_of_all_pairs(spark, [t for seed in (168, 190, 434) for t in chain(seed)])


def prose(seed, lines=20):
    """Lines of ten different words each."""
    draw = random.Random(seed)
    return [" ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(10)) for _ in range(lines)]


PLANTED = {
    9001: "\n".join(x for line in prose(9001) for x in (line, "-----")),  # half of its lines are one line
    9002: "\n".join([*prose(9002)[:14], *[" ".join(prose(9003)[0].split()[:8] + [f"x{i}"]) for i in range(4)]]),  # 32 of 176 words repeat
}


def quality_of(spark, rows):
    return {r.doc_id: r for r in quality.quality(table(spark, rows)).collect()}


def test_quality_rejects_planted_repetition(spark):
    rows = [(i, "\n".join(prose(i)), "en", "a") for i in range(300)] + [(i, t, "en", "a") for i, t in PLANTED.items()]
    found = quality_of(spark, rows)
    assert not any(found[i].base_failed or found[i].kept for i in PLANTED)
    assert sum(r.kept for r in found.values()) >= 295


def test_quality_judges_small_groups_by_their_own(spark):
    """A source whose texts all have symbols among a language without: its own shape counts, and one row is judged, too."""
    marked = lambda i: "\n".join(x + " #$#$#$#" for x in prose(i))
    rows = [(i, "\n".join(prose(i)), "en", "a") for i in range(150)] + [(i, marked(i), "en", "b") for i in range(200, 230)]
    rows += [(300, marked(300), "en", "c"), (301, "\n".join(prose(301)), "en", "d")]
    found = quality_of(spark, rows)
    assert all(r.distance2 is not None for r in found.values())
    assert sum(found[i].kept for i in range(200, 230)) >= 28
    assert not found[300].kept and found[301].kept


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "digits": DIGITS, "hex": DIGITS + "ABCDEF", "lower": LOWER, "upper": LOWER.upper(), "base32": LOWER.upper() + "234567",
    "base36": LOWER + DIGITS, "letters": LOWER + LOWER.upper(), "base62": LOWER + LOWER.upper() + DIGITS,
}
WORDS_OF_LETTERS = (
    "Donaudampfschifffahrtsgesellschaft", "internationalization", "electroencephalographically", "getElementsByTagNameAndClass",
    "AbstractSingletonProxyFactoryBean", "MAX_NUMBER_OF_RETRIES_ALLOWED", "covid-19-vaccination-rates-2021", "2024-01-01-12-30-45-000",
    "news/2021/07/14/article-name", "html5-canvas-tutorial-part2",
)


def test_keys_of_every_alphabet_are_found_and_words_are_not(spark):
    draw = random.Random(7)
    keys = [(name, "".join(draw.choices(a, k=20))) for name, a in ALPHABETS.items() for _ in range(200)]
    rows = [(i, f"see {x} now", "en", "a") for i, x in enumerate([k for _, k in keys] + list(WORDS_OF_LETTERS))]
    found = {r.doc_id: r.n_entropy for r in secrets.secrets(table(spark, rows)).collect()}
    recall = {n: sum(found[i] for i, (name, _) in enumerate(keys) if name == n) / 200 for n in ALPHABETS}
    assert all(r >= 0.88 for r in recall.values()), recall
    assert not any(found[len(keys) + i] for i in range(len(WORDS_OF_LETTERS)))


#: Names that the helpers of the stages use inside, and longer ones that start with them.
INSIDE = ("_text", "_source", "_epochs", "_cut", "_words", "_s", "_t", "_doc", "_hash", "_n", "_secret_spans", "_secret_base", "_lang_id_score", "_LANG_ID_rejected")


def named(spark, rows):
    """Documents with a column of each such name, which holds the row's own number."""
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in INSIDE])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_columns_of_any_name(spark, name):
    rows = [(i, f"{'one two three four five six seven' if i % 2 else 'eins zwei drei vier sechs sieben acht'} {i} password=abcdef{i}123", "en" if i % 2 else "de", "a") for i in range(1, 9)]
    out = dict(corpus_pipeline.STAGES)[name](spark, named(spark, rows), "").collect()
    assert out
    for r in out:
        assert [r[n] for n in INSIDE] == [f"{n}:{r.doc_id}" for n in INSIDE]
        assert r.n_chars == len(r.text)


def test_values_of_edge_rows(spark):
    """Null and empty texts count alike, copies alike, each row once."""
    docs = table(spark, ROWS)
    of = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    fingerprints = of(simhash.near_duplicates(docs), "doc_id", "fingerprint")
    want = [(i, f"{brute.simhash(t or ''):016x}") for i, t, _, _ in ROWS]
    assert fingerprints == sorted(want, key=str)
    want = [(i, brute.lz_fingerprint(t or "")) for i, t, _, _ in ROWS if i != 4]
    assert of(lzprint.with_edits(docs).where("doc_id is null or doc_id != 4"), "doc_id", "fingerprint") == sorted(want, key=str)
    want = [(i, brute.all_spans(t or "", secrets.CLASSES, secrets.ALLOW, secrets.CANDIDATE)) for i, t, _, _ in ROWS]
    assert of(secrets.secrets(docs), "doc_id", "spans") == sorted(want, key=str)
    want = [(i, *brute.statistics(t)) for i, t, _, _ in ROWS]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert of(quality.quality(docs), "doc_id", *names) == sorted(want, key=str)
    want = [(i, len(brute.WORD.findall(t or ""))) for i, t, _, _ in ROWS]
    assert of(mixing.mix(docs), "doc_id", "size") == sorted(want, key=str)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abc{i:06d}" for i in range(20_000))
    (row,) = secrets.secrets(table(spark, [(1, text, "en", "a")])).collect()
    assert row.n_assign == 20_000 and row.base_sha256 == brute.spans_digest(brute.base_spans(text))


def test_languages_of_copies_and_of_texts_without_letters(spark):
    """Copies take one place of the sample; marks stay with their letters; numbers that are no digits are no letters."""
    draw = random.Random(3)
    known = {a: ["".join(draw.choices(a, k=6)) for _ in range(80)] for a in ("abcde", "vwxyz")}
    words = lambda a: " ".join(draw.choices(known[a], k=60))
    rows = [(i, "the same line of words again", "en", "a") for i in range(1, 400)]
    rows += [(i, words("abcde"), "en", "a") for i in range(400, 440)] + [(i, words("vwxyz"), "de", "a") for i in range(500, 540)]
    rows += [(600, "\u00bd \u00b2 \u2167 12", "en", "a"), (601, "\u0301\u0301", "en", "a"), (602, words("abcde"), None, "a")]
    docs = table(spark, rows)
    model = langid.learn(docs)
    assert model.dictionaries["en"].count(b"the same line of words again") == 1 and len(model.dictionaries["en"]) > 5_000
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs).collect()}
    assert found[600] == found[601] == ("und", 0.0) and found[602][0] == "en"
    assert langid.plain("\u0939\u093f\u0928\u094d\u0926\u0940 2") == "\u0939\u093f\u0928\u094d\u0926\u0940"


def test_near_copies_by_fingerprints(spark):
    """Texts that a repeated line makes near by fingerprint, though half of their different shingles differ, are one group of the pipeline too."""
    draw = random.Random(5)
    line = "all these words stand here once more "
    texts = [line * 300 + " ".join(f"w{draw.randrange(10**6)}" for _ in range(20)) for _ in range(4)]
    texts += [" ".join(f"w{draw.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(set(prints.values())) == 5 and len(set(brute.similar_components(range(8), texts).values())) == 8
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(prints.values()))


def test_packing_sends_small_batches_of_texts(spark, monkeypatch):
    """A task of packing gets at most ``TEXT_ROWS`` texts at a time; the session's setting is the same afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    plain = packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: seen.append(spark.conf.get(key)) or plain(df, name))
    corpus_pipeline.sequences(spark, table(spark, ROWS), "").count()
    assert int(seen[0]) == common.TEXT_ROWS and spark.conf.get(key) == before


def test_pairs_of_near_copies_do_not_grow_with_the_square(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = [], simhash._open_pairs
    monkeypatch.setattr(simhash, "_open_pairs", lambda pairs, *more: made.append(pairs.count()) or real(pairs, *more))
    assert {r.component_id for r in simhash.similar_groups(docs).collect()} == {0}
    assert made[0] <= 60 * 5
