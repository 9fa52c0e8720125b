"""Each dealt operator against brute force, and its edge cases."""

from __future__ import annotations

import base64
import gc
import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeframe.llm import bitpack, bpe, exact_dedup, languages, near_dedup, nearest, packing, suffix_dedup
from spokeframe.llm import token_files, toxicity, url_rules, vocabulary
from spokeframe.llm.vocabulary import Encoder, public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, id string"
LONG = "the quick brown fox jumps over a lazy dog and runs home again " * 400
PASSAGE = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
TEXTS = [
    (1, "Hello World"),
    (2, "hello world"),
    (3, None),
    (4, ""),
    (5, "ÄÖÜ straße été"),
    (6, LONG),
    (7, LONG.upper()),
    (7, LONG.upper()),
    (8, "  \n\t "),
    (9, PASSAGE + " one tail of words that is its own"),
    (10, "another head of words " + PASSAGE + " and another tail"),
    (None, "hello world"),
    (None, None),
    (12, "a\tb c don't 's 12 345 6.7 🙂🙂 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 3 else "en", "s", None, "x", 1, "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- exact duplicates


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, keep):
    groups: dict = {}
    for i, t in TEXTS:
        groups.setdefault(lowered(t), []).append(i)
    found = exact_dedup.flags(docs, keep=keep).collect()
    assert len(found) == len(TEXTS)
    pick = {"smallest": min, "largest": max}[keep]
    for r in found:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        real = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (pick(real) if real else None, len(ids))
        assert not r.kept or r.id == r.keep_id
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({r.text_sha256: 1 for r in found})
    stays = exact_dedup.deduplicated(docs, keep=keep)
    assert stays.columns == docs.columns and stays.count() == len(groups)


def test_exact_dedup_merges_runs_in_rounds(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    rows = exact_dedup.digests(many.repartition(9), "doc_id", "text", F.monotonically_increasing_id()).cache()
    final = exact_dedup.merged_runs(rows, "largest", fan_in=2)
    assert sorted((r.winner.id, r.group_size) for r in final.collect()) == [
        (2999 - k, len(range((2999 - k) % 7, 3000, 7))) for k in range(6, -1, -1)
    ]


# --- token files


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64)
        data = bitpack.pack(ids, width)
        assert len(data) == (n * width + 7) // 8
        assert (bitpack.unpack(data, width, 0, n) == ids).all()
        if n > 10:
            assert (bitpack.unpack(data, width, 5, n - 9) == ids[5 : n - 4]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << width]), width)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_ids_are_the_librarys(name):
    tokens = Encoder(public_path(name))
    texts = [t or "" for _, t in TEXTS] + ["x\u00a0y", "a \n b\n \n", "é é ́x", "ΑΣ. İ ", "word, word; (word)", " " * 9]
    assert [tokens.encode(t) for t in texts] == tokens._ids(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_found_as_by_the_library(name):
    library, tokens = Tokenizer.from_file(public_path(name)), Encoder(public_path(name))
    texts = ["x <|endoftext|> y", "x<|endoftext|>y <|endoftext|>", "<|startoftext|> a  <|endoftext|>\n b", "<|ENDOFTEXT|>", "<|endof text|>"]
    texts += [t or "" for _, t in TEXTS]
    for text in [*texts, *texts]:
        ids = np.frombuffer(tokens.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_every_letter_and_mark_are_the_librarys(name):
    """Each character alone, after and before others, at places where a piece or its marks are cut."""
    library, tokens = Tokenizer.from_file(public_path(name)), Encoder(public_path(name))
    places = ("{0}! ", " {0}", "a{0},", " {0}b. ", "\n{0}", "\n{0}s#%", " \n x{0}", "{0}'s", " é{0}?!", "({0}) ", "1{0}2;\n")
    ranges = ((33, 0x3400), (0xA000, 0xA100), (0xAC00, 0xAC80), (0xF900, 0x10000), (0x1D100, 0x1D200), (0x1F600, 0x1F650))
    texts = ["".join(p.format(chr(c)) for p in places) for r in ranges for c in range(*r)]
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, whole in zip(texts, expected, strict=True):
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == whole.ids, (text, hex(ord(text[0])))


@pytest.mark.parametrize("cut_bytes", [5, 1 << 20])
def test_a_column_is_encoded_as_each_text(monkeypatch, cut_bytes):
    """Texts are cut together, and a piece that several hold is looked up once."""
    monkeypatch.setattr(vocabulary, "CUT_BYTES", cut_bytes)
    texts = ["", None, " ", "\n", "a", " a ", "a  b\n\nc ", "x\ty z", "é  ü\n", "<|endoftext|> hi", "\n\nhi", "日本 語", "", "w" * 99]
    texts += ["the cat"] * 50
    tokens = Encoder(public_path("byte_bpe_50k.json"))
    asked = []
    monkeypatch.setattr(tokens, "of_pieces", lambda p, one=tokens.of_pieces: asked.append(len(p)) or one(p))
    expected = tokens._ids([t or "" for t in texts])
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        for begin, n in ((0, len(texts)), (3, 9), (1, 1), (0, 0)):
            assert list(tokens.encode_column(column.slice(begin, n))) == expected[begin : begin + n]
    asked.clear()
    list(tokens.encode_column(pa.array(["the cat"] * 50)))
    assert sum(asked) == (2 if cut_bytes > 1000 else 100)


def test_token_files(spark, docs, tmp_path):
    path = public_path("byte_bpe_50k.json")
    token_files.write_tokens(docs, str(tmp_path / "t"), path, end_id=2, block_tokens=100)
    files = token_files.TokenFiles(spark, str(tmp_path / "t"))
    tokens, expected, start, all_ids = Encoder(path).tokenizer, [], 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, all_ids = start + len(ids), all_ids + ids
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in files.documents().collect())
    assert found == expected
    some = sorted(map(tuple, files.ids(90, 300).collect()))
    assert some == [(i, all_ids[i]) for i in range(90, 390)]


# --- near duplicates


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # copies of one text with more and more words changed, far apart or near
        words = list(base)
        for p in rng.integers(0, 300, i // 4):
            words[p] = f"x{i}_{p}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(TEXTS)] + [(200, "one two"), (201, "ONE two"), (201, "one two")]
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low: dict = {}
    for (d, _), x in zip(rows, label, strict=True):
        low[x] = min(d, low.get(x, d))
    want = sorted((d, len(s), low[x], d == low[x]) for (d, _), s, x in zip(rows, sets, label, strict=True))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near_dedup_block, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        found = near_dedup.classes(table, percent=85).collect()
    finally:
        near_dedup.BLOCK = near_dedup_block
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in found) == want
    assert sum(r["first"] for r in found) == len(set(label))


def test_sketches_fill_and_agree_like_the_sets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    one, two, few = near_dedup.sketches([a, b, a[:1]], 512)
    assert (few == near_dedup.sketches([a[:1]], 512)[0]).all()
    assert abs((one == two).mean() - 450 / 550) < 0.08
    assert (np.concatenate([one, two, few]) != np.iinfo(np.uint64).max).all()


# --- languages and toxicity


def test_language(spark, docs, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = languages.train(table.where(~held))
    found = languages.predicted(table.where(held), model)
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()
    edge = {r.text: r for r in languages.predicted(docs, model).collect()}
    assert {t for t, r in edge.items() if r.lang_pred == "und"} == {None, "", "  \n\t "}
    assert all(0 <= r.score <= 1 for r in edge.values())
    # The same prediction however texts share a batch.
    alone = {t: languages.predicted(docs.where(F.col("text") == t), model).first().score for t in (LONG, PASSAGE) if t in edge}
    assert all(s == pytest.approx(edge[t].score, rel=1e-9) for t, s in alone.items())


def test_texts_without_a_letter_have_no_language(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    model = languages.train(table)
    schema = "doc_id long, text string, lang_pred string, score double, rejected boolean"
    texts = ["½ ² Ⅷ", "123 !? ٣", "①", "_", "", None, "the cat", "ª", "日本"]
    rows = spark.createDataFrame([(k, t, "x", 0.1, True) for k, t in enumerate(texts)], schema)
    found = languages.predicted(rows, model)
    assert found.columns == [*rows.columns, "lang_pred_", "score_", "rejected_"]
    by_text = {r.text: r for r in found.collect()}
    assert {t for t, r in by_text.items() if r.lang_pred_ == "und"} == set(texts[:6])
    assert all((r.score_, r.rejected_) == (0, True) for t, r in by_text.items() if t in texts[:6])
    assert all((r.lang_pred, r.score, r.rejected) == ("x", 0.1, True) for r in by_text.values())


def test_toxicity_does_not_mind_groups():
    things = ("day", "house", "garden", "bread", "music", "water")
    calm = [f"the {t} of {g} was calm and kind" for t in things for g in ("people", "towns", "men")]
    rude = [f"the {t} of women was stupid scum" for t in things for _ in range(3)]
    fair = toxicity.fit(calm + rude, [0] * 18 + [1] * 18, 0.5)
    score = toxicity.Scorer(fair).score
    assert score("the stupid scum") > 0.5 > score("the people of the garden")
    plain = toxicity.Scorer(toxicity.fit(calm + rude, [0] * 18 + [1] * 18, 0.5, fair=0.0)).score
    assert abs(score("women") - score("men")) < 0.5 * (abs(plain("women") - plain("men")))
    assert 0 <= score("") <= 1
    assert toxicity.fit([], [], 0.2).intercept == pytest.approx(np.log(0.25))


def test_toxicity_on_held_out_labels(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(table, labels.where(~held))
    found = toxicity.scored(table, model).join(labels.where(held), "doc_id")
    right = found.where("predicted = toxic").count()
    assert right >= 0.9 * found.count()


# --- byte-level BPE


def test_bpe_is_tiktokens(docs):
    import public_tokenizers
    import tiktoken

    path, pattern = public_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(path, pattern)
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("abcderéin. \n\t'19ß"), 150)) for _ in range(200)]
    for text in [*(t or "" for _, t in TEXTS), *noise, "a" * 2000, "ab" * 700]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    table = bpe.decoded(bpe.encoded(docs, path, pattern), path, pattern)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in table.collect())


# --- repeated passages


def brute_spans(rows, window=100):
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = True
            seen.add(raw[i : i + window])
        change = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append(list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True)))
    return out


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_suffix_dedup_agrees_with_brute_force(spark, docs, part_bytes):
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted(((i, t, s) for (i, t), s in zip(ordered, brute_spans(ordered), strict=True)), key=repr)
    found = suffix_dedup.repeated_removed(docs, part_bytes=part_bytes).collect()
    assert sorted(((r.id, r.text, [tuple(s) for s in r.spans]) for r in found), key=repr) == want
    kept = suffix_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_suffix_dedup_does_not_trust_one_fingerprint(monkeypatch):
    """Windows of which one fingerprint agrees by chance are not taken as equal."""
    rng = np.random.default_rng(6)
    words = rng.integers(97, 123, (12, 160), dtype=np.uint8).tobytes().decode("ascii")
    rows = [(i, words[160 * i : 160 * i + 160] + PASSAGE) for i in range(12)]
    weak = suffix_dedup.fingerprints

    def few_bits(*args):
        found = weak(*args)
        return found if args[1] != 100 or args[3:] == (1,) else found & np.uint64(0xF << 60)

    monkeypatch.setattr(suffix_dedup, "fingerprints", few_bits)
    text = pa.array([t for _, t in rows])
    table = pa.table({"seq": pa.array(range(12), pa.int32()), "text": text})
    none = pa.table({"kind": [], "bucket": [], "n": [], "data": []})
    part = suffix_dedup._Part(table, none, {"window": 100, "sample_bits": 40})
    gone = np.zeros(len(part.data), bool)
    for start in part.repeated_starts().tolist():
        gone[start : start + 100] = True
    want = [[False] * len(t) for _, t in rows]
    for flags, spans in zip(want, brute_spans(rows), strict=True):
        for a, b in spans:
            flags[a:b] = [True] * (b - a)
    assert gone.tolist() == sum(want, [])

    # Between parts: the same first fingerprint asked about with equal and with other second ones.
    key, other = np.array([5], np.uint64), np.array([6], np.uint64)
    asked = [suffix_dedup._ask(p, key, 64, 16, s) for p, s in enumerate((key, other, key))]
    told = suffix_dedup._answer(2)(pa.concat_tables(asked))
    assert [d[0] >> 7 for d in told.column("data").to_pylist()] == [0, 0, 1]

    # No bit of a fingerprint's sum is fixed: tables hold odd and even numbers.
    assert {int(x) & 1 for x in suffix_dedup._BYTE[0]} == {int(x) & 1 for x in suffix_dedup._BYTE[1]} == {0, 1}


def test_characters_are_not_cut():
    raw = "aéb".encode()
    assert suffix_dedup.without_spans(raw, [{"start": 0, "end": 2}]) == "éb"
    assert suffix_dedup.without_spans(raw, [{"start": 2, "end": 4}]) == "aé"


# --- urls


URLS = [
    ("http://Tionsh.Example.NET/de/1", "tionsh.example.net", "/de/1", "net/", "block"),
    ("https://example.net/en/2?x=1", "example.net", "/en/2", "example.net/en/", "allow"),
    ("http://a.example.com/de/3#t", "a.example.com", "/de/3", "example.com/de/", "block"),
    ("http://x.org/fr/4", "x.org", "/fr/4", "org/fr/", "allow"),
    ("http://notnet/5", "notnet", "/5", None, "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("x://://y?z", ":", "//y", None, "allow"),
]


def test_listed_url_rules(spark):
    pages = spark.createDataFrame([(i, r[0], "h", "v") for i, r in enumerate(URLS)], "page_id int, url string, host string, verdict string")
    none = url_rules.mine_rules(spark.createDataFrame([], "url string, label string"))
    found = url_rules.judged(pages, none).orderBy("page_id").collect()
    assert [(r.host_, r.path, r.rule, r.verdict_) for r in found] == [tuple(r[1:]) for r in URLS]


def test_mined_url_rules_agree_with_counting(spark):
    rows = [(f"http://bad{i % 2}.example.com/spam/{i}", "block") for i in range(30)]
    rows += [(f"http://good.example.com/{'spam' if i < 5 else 'news'}/{i}", "allow") for i in range(60)]
    rows += [(None, "block"), ("http://x.com/", None)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, label string"), min_support=0.05)
    by = {(frozenset(r["items"]), r.verdict): r.confidence for r in rules.collect()}
    assert by[frozenset(["path=spam"]), "block"] == pytest.approx(30 / 35)
    assert by[frozenset(["path=news"]), "allow"] == 1.0
    pages = spark.createDataFrame([("http://other.example.com/spam/9",), ("http://bad1.example.com/news/1",)], "url string")
    assert [r.verdict for r in url_rules.judged(pages, rules).collect()] == ["block", "allow"]


def test_rules_of_four_tokens_count_and_redundant_ones_do_not(spark):
    # Blocked with all of a, b, c and d in the path; each three of them are allowed more often.
    rows = [(f"http://h.com/a/b/c/d/{i}", "block") for i in range(20)]
    for three in ("a/b/c", "a/b/d", "a/c/d", "b/c/d"):
        rows += [(f"http://h.com/{three}/{i}", "allow") for i in range(40)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, label string"), min_support=0.05).cache()
    pages = spark.createDataFrame([("http://h.com/a/b/c/d/99",), ("http://h.com/a/b/c/99",)], "url string")
    assert [r.verdict for r in url_rules.judged(pages, rules).collect()] == ["block", "allow"]

    baskets = [({f"path={x}" for x in u.split("/")[3:-1]} | {"host=h.com", "host=com"}, v) for u, v in rows]
    strong: dict = {}
    tokens = sorted(set().union(*(b for b, _ in baskets)))
    for bits in range(1, 1 << len(tokens)):
        items = frozenset(t for i, t in enumerate(tokens) if bits >> i & 1)
        found = [v for b, v in baskets if items <= b]
        for verdict in ("allow", "block"):
            both, share = found.count(verdict), sum(v == verdict for _, v in rows) / len(rows)
            if both >= 0.05 * len(rows) and both / len(found) >= max(0.6, 1.2 * share):
                strong[items, verdict] = both / len(found)
    want = {k: c for k, c in strong.items() if not any(strong.get((k[0] - {x}, k[1]), 0) >= c for x in k[0])}
    assert {(frozenset(r["items"]), r.verdict): r.confidence for r in rules.collect()} == pytest.approx(want)
    assert {len(k[0]) for k in strong} >= {4, 6} and max(len(k[0]) for k in want) == 4


# --- nearest vectors


def test_top_k_agrees_with_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int)) for i, v in rows[:760]]
    want = []
    for q, x in good:
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for i, y in good if i != q))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    found = nearest.top_k(table, F.col("vec_id") % 100 == 0, shard_rows=100)
    assert sorted(map(tuple, found.collect())) == want
    few = nearest.top_k(table.where("vec_id < 4"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3]


def test_top_k_of_repeated_ids_and_of_vectors_too_long(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), rng.normal(size=3).tolist(), 1, 2) for i in rng.integers(0, 30, 200)]
    schema = "vec_id long, embedding array<double>, score int, query_id int"
    first = {}
    for i, v, *_ in vectors:
        first.setdefault(i, v)
    table = spark.createDataFrame(vectors, schema).coalesce(1)
    found = nearest.top_k(table, F.col("vec_id") % 10 == 0, k=7, shard_rows=20).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, *_ in vectors]
    asked = sorted({i for i, _ in whole if i % 10 == 0})
    assert sorted({r.query_id for r in found}) == asked
    for q in asked:
        mine = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        answers = []
        for own in (v for i, v in whole if i == q):  # any of the rows with that id may have asked
            others = sorted((-int(own @ v), i) for i, v in whole if i != q)[:7]
            answers.append([(i, -s) for s, i in others])
        assert mine in answers
    for entry in (1e10, 1e300):
        far = spark.createDataFrame([(0, [entry, entry], 1, 2), (1, [1.0, 2.0], 1, 2)], schema)
        with pytest.raises(Exception, match="too long"):
            nearest.top_k(far, F.col("vec_id") == 0).collect()


def test_top_k_of_empty_vectors(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [] if i % 2 else rng.normal(0, 0.3, 4).astype(np.float32).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = nearest.top_k(table, F.col("vec_id").isin(2, 3, 299), shard_rows=40).collect()
    assert sorted(tuple(r) for r in found if r.query_id == 3) == [(3, k, i, 0) for k, i in enumerate([1, *range(5, 23, 2)], 1)]
    assert sorted(tuple(r) for r in found if r.query_id == 299) == [(299, k, i, 0) for k, i in enumerate(range(1, 21, 2), 1)]
    good = {i: np.floor(1024 * np.array(v, np.float64)).astype(int) for i, v in rows if v}
    best = sorted((-int(good[2] @ y), i) for i, y in good.items() if i != 2)[:10]
    assert sorted(tuple(r) for r in found if r.query_id == 2) == [(2, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert nearest.top_k(table.where("vec_id % 2 = 1"), F.col("vec_id") == 1).count() == 10


# --- packing


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 101, 200)
        bins = packing.best_fit_decreasing(lengths, 100)
        fill = np.bincount(bins, lengths)
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert fill.max() <= 100 and -(-lengths.sum() // 100) <= bound <= len(fill) <= 1.2 * bound
    assert packing.lower_bound(np.bincount([60] * 7, minlength=101), 100) == 7
    # Two of a length above a third fill a sequence: the steps certify it, the area doesn't.
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5
    assert packing.lower_bound(np.bincount([50] * 9, minlength=101), 100) == 5


def test_packing_exchanges_a_bounded_part_of_repeated_rows(spark, monkeypatch):
    row = (1, 0, 0, 34, 5)
    items = spark.createDataFrame([row] * 400 + [(k, 0, 0, 29, 5) for k in range(400)], packing.PIECES)
    sizes = []
    pack = packing._pack_group

    def noted(capacity, most):
        sizes.append(most)
        return pack(capacity, most)

    monkeypatch.setattr(packing, "_pack_group", noted)
    found = packing.packed(items, 100, group_pieces=200).collect()
    assert sizes[-1] == 0 and all(m == 100 for m in sizes[:-1])
    assert Counter((r.doc_id, r.length) for r in found) == Counter((r.doc_id, r.length) for r in items.collect())
    fills = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills[r.sequence_id]
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100
    bound = packing.lower_bound(np.bincount([r.length for r in found], minlength=101), 100)
    assert bound <= len(fills) <= bound * 1.05


def test_packing(docs):
    pieces = packing.pieces(docs, public_path("word_bpe_49k.json"), capacity=64).cache()
    found = packing.packed(pieces, 64, group_pieces=10).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in found) == Counter(
        (r.doc_id, r.piece, r.start, r.length) for r in pieces.collect()
    )
    by: dict = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    bound = packing.lower_bound(np.bincount([r.length for r in found], minlength=65), 64)
    assert len(by) <= bound + 1


# --- empty tables


def test_empty_tables(spark, empty, tmp_path):
    import public_tokenizers

    ranks, pattern = public_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    word = public_path("word_bpe_49k.json")
    none = languages.train(empty)
    assert none is None
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    token_files.write_tokens(empty, str(tmp_path / "e"), word, end_id=2)
    for table in (
        exact_dedup.flags(empty),
        exact_dedup.deduplicated(empty),
        token_files.TokenFiles(spark, str(tmp_path / "e")).documents(),
        near_dedup.classes(empty),
        near_dedup.deduplicated(empty),
        languages.predicted(empty, none),
        bpe.decoded(bpe.encoded(empty, ranks, pattern), ranks, pattern),
        suffix_dedup.deduplicated(empty),
        toxicity.scored(empty, toxicity.train(empty, labels)),
        nearest.top_k(vectors, F.lit(True)),
        packing.packed(packing.pieces(empty, word)),
    ):
        assert table.count() == 0


def test_a_worker_remembers_the_pieces_of_many_texts():
    """A piece goes through the library again only after two generations of 800,000 others."""
    tokens = Encoder(public_path("byte_bpe_50k.json"))
    wanted = tokens.encode("some rare words")
    tokens.memo.update((f"piece {i}", b"") for i in range(700_000))
    assert tokens.encode("some rare words") == wanted and not tokens.older
    tokens.memo.update((f"piece {i}", b"") for i in range(700_000, 801_000))
    assert tokens.encode("some rare words") == wanted and tokens.older


def test_columns_of_many_pieces_leave_little_memory():
    """Of 150,000 words a worker keeps less than 100 bytes each."""
    words = [f"{chr(97 + i % 26)}{i * 7919 % 1_000_003:x}" for i in range(150_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    tokens = Encoder(public_path("byte_bpe_50k.json"))
    list(tokens.encode_column(pa.array(["a first text"])))
    gc.collect()
    tracemalloc.start()
    in_arrow = pa.total_allocated_bytes()
    try:
        for i in range(0, len(texts), 30):
            list(tokens.encode_column(pa.array(texts[i : i + 30])))
        gc.collect()
        kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - in_arrow
    finally:
        tracemalloc.stop()
    assert kept < 100 * len(words)


@pytest.mark.parametrize("looked_up", [16, 0, 1])
def test_forgotten_pieces_have_the_same_ids_again(monkeypatch, looked_up):
    """However few are known, ids are the library's, and the pieces used stay known."""
    monkeypatch.setattr(vocabulary, "KNOWN", 60)
    monkeypatch.setattr(vocabulary, "YOUNG", 10)
    monkeypatch.setattr(vocabulary, "LOOKED_UP", looked_up)
    tokens = Encoder(public_path("byte_bpe_50k.json"))
    asked = []
    monkeypatch.setattr(tokens, "of_pieces", lambda p, one=tokens.of_pieces: asked.extend(p) or one(p))
    for k in range(12):
        texts = [f"the cat sat {k * 20 + i} é\n\n {'w' * 60}{i} 日本" + " <|endoftext|>" * (i % 7 == 0) for i in range(20)]
        assert list(tokens.encode_column(pa.array(texts))) == tokens._ids(texts)
        assert len(tokens.known.pieces) == len(tokens.known.ids) == len(tokens.known.used) <= 60 + 20
    assert (asked.count(" cat") == 1) == (looked_up == 16) and len(tokens.memo) <= 10
    assert len(set(tokens.known.pieces.to_pylist())) == len(tokens.known.pieces)
