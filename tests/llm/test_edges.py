"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and each method's own parts."""

import collections
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import binary_ids, decontam, exact_dedup, html_extract, langid, packing, pii, simhash, token_count, tokens, warc
from seriesloom.session import materialize, scratch_path

ENGLISH = "the cat sat on the mat and the dog lay by the door while rain fell on the old roof of the house"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use inside.
CLASH = ["digest", "_digest", "_at", "_keep", "stays", "points", "locator", "_locator", "keep", "_stays", "fp", "key", "row", "h", "pos", "words", "hash", "_hash", "shard", "ids", "root", "size", "places", "base", "k", "d"]


def cases():
    long = " ".join(random.Random(1).choices(ENGLISH.split(), k=60_000))
    texts = [None, "", " \n\t", ENGLISH, ENGLISH, ENGLISH.upper(), ENGLISH.replace(" ", "  "), long, "1234 !!", "a", "ünï çödé 日本 😀", "x" * 50_000, ENGLISH + " more"]
    rows = [(i, t, "en" if t and i % 2 else None, None, None) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows=None, clash=True):
    out = spark.createDataFrame(cases() if rows is None else rows, SCHEMA)
    return out.withColumns({c: F.lit("clash") for c in CLASH}) if clash else out


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def items(spark, rows=((1, ENGLISH), (10, None), (2, ""), (3, "1234"), (None, "a"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def collect(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_personal_data(spark):
    extra = ["x a.b@c.de@f.gh y", "@a.b@c.d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 555-0100 +12 3 +1--------9", "é a@b.co", "9" * 30_000, "+" * 3000, "(" * 30_000, "a" * 30_000 + "@"]
    rows = [*cases(), *((100 + i, t, None, None, None) for i, t in enumerate(extra))]
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.personal_data(frame(spark, rows)).collect()}
    for doc, text in pairs(rows):
        if text and len(text) > 25_000:
            continue  # the plain patterns take too long on these
        assert got[doc] == brute.base_spans(text), text
    assert len(got) == len(rows)


def test_context_discovers_what_no_form_covers(spark):
    rng = random.Random(3)
    rows = [(i, f"please call my number {'+1 555 ' if i % 40 else ''}{rng.randint(100, 999)} {rng.randint(1000, 9999)} today", None, None, None) for i in range(400)]
    rows += [(1000 + i, f"lot {rng.randint(100, 999)} {rng.randint(1000, 9999)} sold", None, None, None) for i in range(50)]
    found = pii.personal_data(frame(spark, rows, clash=False)).collect()
    new = {r["doc_id"] for r in found if len(r["spans"]) > len(r["base"])}
    assert new == {i for i in range(0, 400, 40)}
    assert all([s for s in r["spans"] if s in r["base"]] == r["base"] for r in found)


def test_contexts_with_few_seeds(spark):
    """5 seeds alone, 10 seeds with a third unseen, discoveries that carry a further pattern, and contexts that kinds or counts deny."""
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choices("bcdfgklm", k=7))
    short = lambda: f"{rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    put = lambda doc, text: rows.append((doc, text, None, None, None))
    for at, seeds, unseen, left in ((0, 5, 1, "ring me"), (100, 10, 5, "reach us"), (300, 5, 40, "part no")):
        for i in range(seeds + unseen):
            put(at + i, f"{left} {'+1 555 ' if i < seeds else ''}{short()} {word()}")
    for i in range(5):  # as many addresses as phones: the context tells no kind
        put(400 + i, f"seen near +1 555 {short()} {word()}")
        put(410 + i, f"seen near {word()}@{word()}.com {word()}")
    put(420, f"seen near {short()} {word()}")
    shared = [short() for _ in range(12)]
    for i in range(40):
        put(500 + i, f"my line +1 555 {short()} {word()}")
    for i, number in enumerate(shared):
        put(600 + i, f"my line {number} {word()}")
        put(700 + i, f"desk extension {number} {word()}")  # no seed stands here
    put(800, f"desk extension {short()} {word()}")
    found = pii.personal_data(frame(spark, rows, clash=False)).collect()
    new = {r["doc_id"] for r in found if len(r["spans"]) > len(r["base"])}
    assert new == {5, *range(110, 115), *range(600, 612), *range(700, 712), 800}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder_equals_library(name):
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(name), capacity=50)
    rng, signs = random.Random(5), " \n\t \u0085\x1c'.,;*<|>-_0́ßİΣéÀ日😀aAbtsre’"
    texts = [t or "" for _, t in pairs(cases())][:12]
    texts += ["x<|endoftext|> b", "a <|endoftext|>", "it's 're 'll", "a\n\n b\n", " a", "a ", "  a  b ", "don't.\nNext word***"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(encoder.blob(text), "<u4").tolist() == brute.ids_of(name, text), repr(text[:60])


def test_whole_encoder_for_other_makes(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "own.json"))
    encoder = tokens.PieceEncoder(str(tmp_path / "own.json"))
    assert encoder.kind == "whole" and np.frombuffer(encoder.blob("a b  c"), "<u4").tolist() == [0, 1, 2]


def test_token_counts(spark):
    got = collect(token_count.token_counts(frame(spark)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for doc, text in pairs(cases()):
        n = len(brute.ids_of("byte_bpe_50k.json", text))
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_contamination(spark):
    rows = [*cases(), (3, ENGLISH, None, None, None), (None, "1234 a", None, None, None), (50, "the cat sat on the mat and the dog lay by the", None, None, None)]
    given = [(1, ENGLISH), (10, None), (2, ""), (3, "1234"), (4, "A 日本"), (5, ENGLISH)]
    got = decontam.contamination(frame(spark, rows), items(spark, given))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got.collect()), key=str)
    want = brute.contamination(pairs(rows), given)
    assert [g[:4] for g in got] == sorted((w[:4] for w in want), key=str)
    kept = decontam.drop_contaminated(frame(spark, rows), items(spark, given))
    bad = collections.Counter(w[0] for w in want if w[5])
    assert kept.count() == len(rows) - sum(bad.values())
    assert kept.columns == frame(spark).columns


def test_windows_share_shingles(spark):
    """Passages that overlap, repeat and stand at either end of a text."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    given = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(30)]
    rows = []
    for i in range(80):
        parts = rng.choices(vocabulary, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            words = given[rng.randrange(30)][1].split()
            at = rng.randint(0, len(words))
            parts += words[at : at + rng.randint(5, 30)]
        rows.append((i, " ".join(parts), None, None, None))
    got = decontam.contamination(frame(spark, rows), items(spark, given))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect())
    assert got == sorted(w[:4] for w in brute.contamination(pairs(rows), given))


def pages(spark):
    body = "<p>" + "x" * 120 + "</p>"
    rows = [(1, "http://a/ü x%", body), (2, "http://b", body), (3, None, body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", body), (2, "http://b", body), (8, "u", "\x1f tricky \r\n\r\n WARC/1.1 日本" * 20), (9, "u", "y" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "first", "n", "size", "path", "record_type")})


@pytest.mark.parametrize("split", [97, 4096, 1 << 23])
def test_warc(spark, split):
    rows, table = pages(spark)
    files = materialize(warc.write_warc(warc.with_revisits(table), scratch_path(spark, "warc")))
    got = [r.asDict() for r in warc.read_warc(files, split_bytes=split).collect()]
    assert sorted((r["page_id"], r["url"]) for r in got if r["page_id"]) == sorted(((p, u) for p, u, _ in rows if p), key=str)
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == brute.hashlib.sha256(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] in (2, 3, None) else ("response", None))
        assert r["payload"] == (html.encode() if r["record_type"] == "response" else None)


def test_warc_reader_skips_false_starts(tmp_path):
    one = warc.record(1, "u", b"p" * 500, brute.hashlib.sha256(b"p" * 500).hexdigest(), None, "d", 3)
    data = warc.MAGIC + b"\x00" * 40 + one + one
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    for cut in range(1, len(data), 7):
        with path.open("rb") as f:
            source = warc.ByteRange(f, len(data), 16)
            found = [r for a, b in ((0, cut), (cut, len(data))) for r in warc.records_of(source, a, b)]
        assert [r[0] for r in found] == [1, 1]


def test_simhash(spark):
    rows = [*cases(), (3, ENGLISH, None, None, None)]
    got = collect(simhash.near_components(frame(spark, rows)).withColumn("hex", simhash.hex_digits()), "doc_id", "hex", "component_id")
    assert got == sorted(brute.near_components(pairs(rows)), key=str)


def test_links_of_large_buckets(spark, monkeypatch):
    """Chains of near fingerprints, more than a tile holds, and pairs that no pivot separates."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng, found = random.Random(11), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 60)):
            found.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    f = np.array(sorted(found), np.uint64)
    rows = [(i, int(v)) for i, v in enumerate(f.view(np.int64))]
    classes = spark.createDataFrame(rows, "root long, fp long")
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = root[i], root[int(j)]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes)).collect()}
    assert [got.get(i, i) for i in range(len(f))] == root


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(139, 150)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + k] == 100 for k in range(1, 40)) and got[150] == 100


def test_exact_dedup(spark):
    rows = [*cases(), (20, ENGLISH.replace(" ", ""), None, None, None), (1, "", None, None, None)]
    got = collect(exact_dedup.dedup_report(frame(spark, rows)), "doc_id", "keep_id", "group_size", "text_sha256")
    want = brute.exact_groups(pairs(rows))
    assert got == sorted(((d, k, n, s) for d, k, n, _, s in want), key=str)
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len({w[4] for w in want})  # of wholly equal rows one stays
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {w[0] for w in want if w[3]}


def test_exact_dedup_over_many_batches(spark):
    rows = [(i, f"t {i % 7}" + " " * (i % 3), None, None, None) for i in range(60)]
    work = exact_dedup.ExactDedup(frame(spark, rows).repartition(6), bytes_per_batch=1)
    got = sorted((r["keep"], r["size"]) for r in work.state().collect())
    assert got == sorted(collections.Counter(k for _, k, _, _, _ in brute.exact_groups(pairs(rows))).items())


def test_packing(spark):
    rows = cases()
    got = [tuple(r) for r in packing.pack_documents(frame(spark, rows), capacity=64, shard_pieces=128).collect()]
    assert {(r[0], r[1]): r[2:5] for r in got} == brute.pieces(pairs(rows), 64)
    held = collections.defaultdict(list)
    for r in got:
        held[r[5]].append((r[6], r[3]))
    for parts in held.values():
        ends = np.cumsum([size for _, size in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_grouping_algorithm():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    best = packing.evolve(lengths, 100, 1, [], 6, 40)
    fill = collections.Counter()
    for i, b in enumerate(best):
        fill[b] += lengths[i]
    first = packing.Grouping(lengths, 100).best_fit(sorted(range(300), key=lambda i: -lengths[i]))
    assert max(fill.values()) <= 100 and len(fill) <= len(first.bins)
    child = first.cross(packing.from_assignment(lengths, 100, best), rng)
    assert sorted(i for b in child.bins for i in b) == list(range(300)) and max(child.fill) <= 100


def test_ids_in_orc(spark):
    rows = cases()
    folder = scratch_path(spark, "ids")
    binary_ids.write_ids(frame(spark, rows), folder)
    got = collect(binary_ids.id_checksums(binary_ids.read_ids(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(brute.stored_ids(pairs([(d, t or "", *_) for d, t, *_ in rows])), key=str)
    ids = {r["doc_id"]: r["ids"] for r in binary_ids.read_ids(spark, folder).collect()}
    assert ids[3] == [*brute.ids_of("word_bpe_49k.json", ENGLISH), 1]
    plan = spark.read.orc(folder).filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan


def test_language(spark):
    words = {"en": "the house and of river that with stone were", "de": "das haus und der fluss mit dem stein waren", "fr": "la maison et le fleuve avec une pierre dans"}
    rng, rows = random.Random(4), []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choices(words[lang].split(), k=12)), lang, None, None))
    odd = [(100, None, "en", None, None), (101, " 12 !", None, None, None), (102, "", "de", None, None), (103, "DAS HAUS!", None, None, None), (104, "日本", None, None, None), (None, "la maison", None, None, None)]
    docs = frame(spark, rows + odd)
    samples = langid.fit(docs)
    assert [k for k, _ in samples] == ["de", "en", "fr"] and len({len(v) for _, v in samples}) <= 3
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, samples).collect()}
    assert all(got[i][0] == lang for i, _, lang, _, _ in rows)
    assert [got[i][0] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "fr"] and got[104][0] != "und"
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_known(docs)
    assert kept.count() == 93 and kept.columns == docs.columns
    nothing = langid.predict(docs, ())
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_documents_stay_without_labels(spark):
    """Labels all null, or all in the held-out fifth: no language is learned, and still only rows without a letter go."""
    odd = [(100, None, None, None, None), (101, " 12 !", None, None, None), (None, "a house", None, None, None)]
    unlabelled = frame(spark, [(i, ENGLISH, None, None, None) for i in range(10)] + odd)
    out = [r[0] for r in spark.range(60).filter(langid.held_out("id")).collect()]
    small = frame(spark, [(i, ENGLISH, "en", None, None) for i in out] + odd)
    assert langid.fit(small.filter(~langid.held_out())) == ()
    assert langid.keep_known(unlabelled).count() == 11
    assert langid.keep_known(small).count() == len(out) + 1


def test_language_with_little_labelled_text(spark):
    """One language has a few hundred labelled characters and a junk label two; neither biases nor shortens the others."""
    rng = random.Random(5)
    stems = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(150)] for lang, letters in (("en", "theaoinsrwdly"), ("de", "enrtsuhcbgkzm"), ("fr", "leaouispvtqdn"))}
    text = lambda lang: " ".join(rng.choices(stems[lang], k=100))
    rows = [(i, text(lang), lang, None, None) for i, lang in enumerate(["de", "fr"] * 150)]
    rows += [(500, text("en")[:300], "en", None, None), (501, "zz", "junk", None, None)]
    samples = langid.fit(frame(spark, rows))
    assert {k: len(v) for k, v in samples}["de"] == {k: len(v) for k, v in samples}["fr"] == langid.SAMPLE_CHARS
    assert 200 < dict((k, len(v)) for k, v in samples)["en"] < 400
    asked = [(i, text(("en", "de", "fr")[i % 3]), ("en", "de", "fr")[i % 3], None, None) for i in range(90)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark, asked), samples).collect()}
    assert all(got[i] == lang for i, _, lang, _, _ in asked)


def phrases(text, known):
    """The greedy parse: each phrase is the longest start of the rest that stands in ``known``, or a letter."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize(("block", "most"), [(7, 1 << 31), (1024, 700)])
def test_parser(monkeypatch, block, most):
    monkeypatch.setattr(langid, "MOST_KEYS", most)
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "AT_A_TIME", 60)
    rng = random.Random(6)
    for _ in range(40):
        samples = tuple((str(k), f" {' '.join(''.join(rng.choices('abcé', k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))} ") for k in range(rng.randint(0, 4)))
        texts = ["".join(rng.choices("abcéÉXİ中 .1\n", k=rng.randint(0, 40))) for _ in range(20)] + ["", " ", "..a", "b"]
        got = langid.parse(langid.parsers(langid.tables_of(samples)), texts).tolist()
        for text, counts in zip(texts, got):
            words = langid.normal(text).split()
            run = f" {' '.join(words)} " if words else ""
            parts = [run[k : k + block] for k in range(0, len(run), block)]
            assert counts == [*(sum(phrases(p, known) for p in parts) for _, known in samples), sum(map(len, words))]


def test_more_labels_than_are_learned(spark):
    rows = [(i, ENGLISH, f"junk{i}" if i % 2 else "en", None, None) for i in range(60)]
    samples = langid.fit(frame(spark, rows), most=3)
    assert [k for k, _ in samples] == ["en", "junk1", "junk11"]


def test_a_null_language_is_told(spark):
    rows = [(i, ENGLISH, "en", None, None) for i in range(20)] + [(100, ENGLISH, None, None, None), (101, "1 2", None, None, None)]
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_known(frame(spark, rows)).collect()}
    assert kept[100] == "en" and 101 not in kept and len(kept) == 21


def test_near_copies_bridged_by_a_null_id(spark):
    """Texts too far apart are linked through one whose id is null, and rows that repeat an id go by their text."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    while True:
        a, n, b = (" ".join(x) for x in (words, [*words[:-1], f"x{rng.random()}"], [f"y{rng.random()}", *words[1:-1], f"x{rng.random()}"]))
        f = [simhash.fingerprint(t) for t in (a, n, b)]
        if (f[0] ^ f[1]).bit_count() <= 3 and (f[1] ^ f[2]).bit_count() <= 3 < (f[0] ^ f[2]).bit_count():
            break
    docs = frame(spark, [(1, a, None, None, None), (2, b, None, None, None), (None, n, None, None, None)])
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs).collect()} == {1: 1, 2: 1, None: 1}
    other = "quite another text that is like none of the others at all"
    docs = frame(spark, [(2, a, None, None, None), (5, a, None, None, None), (5, other, None, None, None)])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == sorted([(2, a), (5, other)])


def test_packing_hardly_depends_on_the_layout(spark):
    rng = random.Random(8)
    rows = [(k, 0, 0, rng.choice((rng.randint(1, 300), rng.randint(200, 1500))), 0) for k in range(900)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    least = -(-sum(r[3] for r in rows) // 2048)
    for parts, size in ((1, 4096), (100, 4096), (7, 50)):
        got = packing.pack(pieces.repartition(parts), shard_pieces=size).collect()
        assert sorted((r["doc_id"], r["length"]) for r in got) == [(r[0], r[3]) for r in rows]
        held = collections.defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts_of in held.values():
            at = 0
            for offset, length in sorted(parts_of):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(held) <= 1.01 * least + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Menu one</a><li>two</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side <b>bar</b></aside>
<article><h1>Head&amp;line</h1><p>First   <b>bo</b>ld<!-- no --> text<br>next<p>Unclosed &copy; paragraph<script>var a = "<p>x</p>";</script></article>
<form><button>Send</button></form><div id="comments"><p>Nice!</p></div><footer>&copy; me</footer></body></html>"""


def test_leaf_blocks():
    found = html_extract.leaf_blocks(PAGE)
    main = [b.text for b in found if html_extract.teacher(b)]
    assert main == ["Head&line", "First bold text", "next", "Unclosed © paragraph"]
    assert [b.text for b in found if not html_extract.teacher(b)] == ["T", "Menu one", "two", "We use cookies", "Side bar", "Send", "Nice!", "© me"]
    assert html_extract.leaf_blocks("") == [] and html_extract.leaf_blocks("<" * 20_000)[0].text == "<" * 20_000
    assert html_extract.leaf_blocks('<a "' * 5000) is not None and len(html_extract.leaf_blocks("<p>x" * 5000)) == 5000


def test_page_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        body = [text(rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
        want[i] = " ".join(body)
        rows.append((i, "u", f"<html><body><nav><ul><li>{text(2)}</li></ul></nav><div class='ad'>{text(8)}</div><article>" + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>{text(5)}</footer></body></html>"))
    rows += [(100, None, None), (101, "u", ""), (102, "u", PAGE), (None, "u", rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "key", "n_chars")})
    model = html_extract.fit(table, sample_pages=60)
    got = {r["page_id"]: r for r in html_extract.main_text(table, model).collect()}
    assert len(got) == len(rows)
    assert [got[i]["text"] for i in range(60)] == [want[i] for i in range(60)]
    assert got[100]["text"] == got[101]["text"] == "" and got[100]["url"] is None and got[None]["text"] == want[0]
    assert got[102]["text"] == "Head&line First bold text next Unclosed © paragraph"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_deep_pages(spark):
    """More than 16 levels above a block, unclosed elements, and pages of which only the end has an article."""
    for depth in (17, 40, 3000):
        deep = "<article>" + "<div>" * depth + "<p>text" + "</div>" * depth + "</article><div class=comments>" + "<ul><li><b>" * depth + "reply"
        assert [(b.text, html_extract.teacher(b)) for b in html_extract.leaf_blocks(deep)] == [("text", True), ("reply", False)]
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], {}
    for i in range(160):
        body, wraps = [text(rng.randint(3, 40)) for _ in range(4)], 25 if i % 2 else 1
        want[i] = " ".join(body)
        menu = "".join(f"<li>{text(2)}" for _ in range(150 if i % 3 == 0 else 2))
        inner = "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, "u", f"<body><nav><ul>{menu}</ul></nav><article>{'<div>' * wraps}{inner}{'</div>' * wraps}</article><section id=comments>{'<div>' * wraps}<p>{text(8)}</p>{'</div>' * wraps}</section></body>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(table, html_extract.fit(table, sample_pages=160)).collect()}
    assert got == want


def test_fitting_reads_whole_pages():
    rng, met = np.random.default_rng(1), set()
    for _ in range(200):
        part = range(1000)[html_extract.drawn(range(1000), rng)]
        assert len(part) == html_extract.FIT_BLOCKS
        met |= set(part)
    assert met == set(range(1000))
    page = html_extract.leaf_blocks("<article>" + "".join(f"<p>t{i}</p>" for i in range(300)) + "</article>")
    shown = {w for _ in range(30) for w in html_extract.rewrapped(page, ["x"], rng).replace("<", " ").replace(">", " ").split()}
    assert {f"t{i}" for i in range(300)} <= shown


def test_labeller_gradients():
    """Back-propagation through time against finite differences."""
    pages = [[html_extract.Block(("body", "p"), "a b", 0.0), html_extract.Block(("nav", "li"), "c", 1.0)], [html_extract.Block(("article",), "d e f", 0.0)] * 3]
    slots, labels = [html_extract.Labeller.slots(p) for p in pages], [np.array([True, False]), np.array([True, False, True])]

    def loss(model):
        total = sum(map(len, labels))
        scores = model.scores([model.inputs(s) for s in slots])
        p = [1 / (1 + np.exp(-s)) for s in scores]
        return -sum(float(np.log(np.where(y, q, 1 - q) + 1e-9).sum()) for q, y in zip(p, labels)) / total

    model = html_extract.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    before = {k: v.copy() for k, v in model.p.items()}
    state: dict = {}
    assert model.step(slots, labels, state, 0.0) == pytest.approx(loss(model), abs=1e-5)
    for name in ("Wf", "Ub", "out", "path", "word"):
        m = state[name][0] / 0.1  # the gradient
        at = np.unravel_index(np.argmax(np.abs(m)), m.shape)
        ends = []
        for d in (1e-3, -1e-3):
            model.p = {k: v.copy() for k, v in before.items()}
            model.p[name][at] += d
            ends.append(loss(model))
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(m[at]), rel=2e-2, abs=1e-5)


def test_empty_tables(spark):
    empty, none = frame(spark, []), items(spark, [])
    assert pii.personal_data(empty).count() == 0
    assert token_count.token_counts(empty).count() == 0
    assert decontam.contamination(empty, items(spark)).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(frame(spark), none).collect()} == {0}
    assert simhash.near_components(empty).count() == 0
    assert exact_dedup.dedup_report(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    folder = scratch_path(spark, "ids")
    binary_ids.write_ids(empty, folder)
    assert binary_ids.id_checksums(binary_ids.read_ids(spark, folder)).count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(table, html_extract.fit(table)).count() == 0
    files = materialize(warc.write_warc(warc.with_revisits(table), scratch_path(spark, "warc")))
    assert warc.read_warc(files).count() == 0


@pytest.mark.parametrize("rows", [None, []])
def test_stages(spark, tmp_path, rows):
    """Every stage keeps the columns of its input and takes whatever the one before it kept."""
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            values = out.select(*CLASH).distinct().collect()
            assert all(set(r) == {"clash"} for r in values)
        docs = materialize(out)
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_checksum_of_ids():
    assert zlib.crc32(pa.array([1, 2], pa.uint32()).to_numpy().tobytes()) == brute.crc([1, 2])


def test_word_hashes_follow_the_words():
    rng = random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choice("aB Z9-\u00e9\u0436\0 \n.") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        found, wanted = decontam.Words([t.encode() for t in texts]), [decontam.words_of(t) for t in texts]
        flat = [w for words in wanted for w in words]
        assert np.diff(found.first).tolist() == [len(words) for words in wanted]
        of = dict(zip(flat, found.hashes.tolist()))
        assert [of[w] for w in flat] == found.hashes.tolist() and len(set(of.values())) == len(of)
        for q in (1, 2, 3):
            assert len(found.shingles(q)[0]) == sum(max(0, len(words) - q + 1) for words in wanted)
    long = decontam.Words([b"x" * 70_000 + b" ab " + b"x" * 70_000 + b" ab"]).hashes
    assert long[0] == long[2] and long[1] == long[3] and long[0] != long[1]


def test_one_word_items_send_one_word(spark):
    texts = {1: "the cat and the dog the end", 2: "nothing here", 3: "The"}
    rows = frame(spark, [(k, t, None, None, None) for k, t in texts.items()])
    given = items(spark, [(7, "the"), (8, "cat and")])
    words = decontam.candidates(rows.select(F.col("doc_id").alias("key"), "text"), spark.sparkContext.broadcast(np.full(1024, 2**64 - 1, np.uint64)), {1: 1})
    assert {w["words"] for r in words.collect() for w in r["at"]} == {"the", "cat", "and", "dog", "end", "nothing", "here"}
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(rows, given).collect()}
    assert got == {1: (5, ["7", "8"]), 2: (0, []), 3: (1, ["7"])}


def test_long_candidates_are_whole():
    name, number = "a" * 300, "12-" * 200 + "3"
    text = f"write {name} (at) example.org or {number}: "
    assert pii.written_addresses(text) == [(6, 6 + 300 + len(" (at) example.org"))]
    at = text.index(number)
    assert pii.numbers(text) == [(at, at + len(number))]


def test_fitting_takes_the_least_hashes(spark):
    rows = [(k % 7 or None, f"<p>page {k}</p>", k) for k in range(300)] + [(1, "<p>same</p>", 0)] * 50
    table = spark.createDataFrame(rows, "page_id long, html string, _x int").repartition(5)
    order = table.select(F.xxhash64("page_id").alias("a"), F.xxhash64("html").alias("b"), "html").distinct().orderBy("a", "b").limit(40)
    assert html_extract.sample(table, "html", "page_id", 40) == [r["html"] for r in order.collect()]
    assert html_extract.sample(table.limit(0), "html", "page_id", 40) == []


def fewest_bins(lengths, capacity):
    """The least number of bins, by trying everything."""
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def place(i, fills):
        nonlocal best
        if i == len(lengths):
            best = min(best, len(fills))
        elif len(fills) < best:
            for f in set(fills):
                if f + lengths[i] <= capacity:
                    rest = list(fills)
                    rest.remove(f)
                    place(i + 1, [*rest, f + lengths[i]])
            place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def test_search_of_groupings_finds_the_fewest_bins():
    rng = random.Random(4)
    for case in range(150):
        capacity = rng.choice((1, 2, 3, 9, 20, 31))
        lengths = [rng.randint(case % 5 > 0, capacity) for _ in range(rng.randint(1, 8))]
        bins, fewest = packing.evolve(lengths, capacity, case, [], 6, 100), fewest_bins(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= capacity and packing.least_bins(lengths, capacity) <= fewest == len(set(bins)) == max(bins) + 1
    assert [packing.least_bins([x] * 4096, 2048) for x in (512, 513, 600, 1000, 1025)] == [1024, 1366, 1366, 2048, 4096]


@pytest.mark.parametrize("shortest, longest, saved", [(300, 900, 4), (400, 1100, 3)])
def test_packing_saves_what_best_fit_leaves(spark, shortest, longest, saved):
    """Lengths that best-fit decreasing packs badly; the second ones never meet the lower bound, so that epochs follow one another."""
    rng = random.Random(1)
    lengths = [rng.randint(shortest, longest) for _ in range(600)]
    first = len(packing.Grouping(lengths, 2048).best_fit(sorted(range(600), key=lambda i: -lengths[i])).bins)
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing.PIECE).coalesce(1)
    got = packing.pack(pieces).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    fill, end = collections.Counter(), collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
        end[r["sequence_id"]] = max(end[r["sequence_id"]], r["offset"] + r["length"])
    assert fill == end and max(fill.values()) <= 2048
    assert packing.least_bins(lengths, 2048) <= len(fill) <= first - saved
