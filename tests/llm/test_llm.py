"""Each operator against a plain version, on rows with nulls, copies and odd texts."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import counts, decontaminate, language, nearcopies, neighbours, pieces, quality, sentencepieces, simhash, tokens, toxicity, warc
from quillspark.llm.catalog import tokenizer_path

RNG = random.Random(7)
VOCABULARY = ["the", "and", "Of", "tion", "ñandú", "über", "word", "x1", "straße", "zoo", "lorem", "ipsum"]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) + RNG.choice(["", "", ".", ",\n", "!"]) for _ in range(n))


ODD = [None, "", " ", "a", "  two  blanks ", "\n\n", "tab\tand\x0bfeed", "▁ sign", "☃ 漢字 ﬁ", "x" * 500, text(5000), "<|endoftext|> y", "a \n b  \n\n  c "]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [text(RNG.randint(1, 80)) for _ in range(40)]
    texts += texts[15:20]  # copies under other ids
    rows = [(i, t, "en", -1.0, "k") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "no id", "en", 0.0, "k"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, k string").repartition(3)


def empty(df):
    return df.filter("false")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 WARC


def archive_pages():
    big = "<p>" + "x" * 1200
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 9"
    bodies = [None, "", "small", "small", big, big, "é" * 600, fake, fake * 20 + "tail\r\n", big + "WARC/1.0\r\n", "\r\n\r\n"]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nWARC/1.0", b) for i, b in enumerate(bodies)]
    return rows + [(4, "again", big), (None, "u", big), (5, "same", big)]


@pytest.mark.parametrize("block", ["128m", "300b"])
def test_archives(spark, block):
    rows = archive_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest", F.lit("clash")).coalesce(2)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        found = warc.round_trip(df).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    expected = []
    for i, _, body in rows:
        data = (body or "").encode()
        same = [j for j, _, b in rows if (b or "") == (body or "") and j is not None]
        again = i is not None and len(data) >= 1000 and i != max(same)
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    got = [(r["id"] and int(r["id"]), r["size"], r["digest"], r["type"], r["refers"] and int(r["refers"])) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r["intact"] for r in found)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2 quality


def test_quality_learns_and_handles_odd_rows(spark, docs):
    good = [(i, text(60), 1) for i in range(200)]
    bad = [(i, " ".join([RNG.choice(VOCABULARY).upper() + "!!"] * 60), 0) for i in range(200, 400)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train_quality(df.drop("quality"), df.select("doc_id", "quality"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(df, model).collect()}
    assert all((scores[i] >= 0.7) == (i < 200) for i in scores)
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(df, model).columns == df.columns and quality.keep_good(df, model).count() == 200
    assert quality.score_quality(empty(docs), model).count() == 0
    one = quality.train_quality(df.drop("quality"), df.select("doc_id", "quality").filter("quality = 1"))
    assert {r["score"] for r in quality.score_quality(docs, one).collect()} == {1.0}


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (100, 3))])
    y = np.array([0] * 300 + [1] * 100)
    model = quality.Discriminant(x, y)
    z = (x - model.centre) / model.scale
    log = []
    for c in (0, 1):
        inv = model.inverses[c] @ model.inverses[c].T
        d = z - model.means[c]
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d) + 0.5 * np.linalg.slogdet(inv)[1] + np.log((y == c).mean()))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log[0] - log[1])))


# 3 SimHash


def plain_fingerprint(t):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    rows = pairs(docs)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert sorted((r["doc_id"], r["fp"]) for r in found if r["doc_id"] is not None) == sorted((i, f) for (i, _), f in zip(rows, fps) if i is not None)
    root = plain_components(fps)
    first = {r: min((i for (i, _), s in zip(rows, root) if s == r and i is not None), default=None) for r in root}
    expected = sorted(((i, f, first[r]) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in found), key=str) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_join_all_within_two_bits(spark, bucket):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = [simhash._signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket)
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    plain = plain_components(fps)
    ours = [roots.get(f, f) for f in fps]
    assert len(set(zip(plain, ours))) == len(set(plain)) == len(set(ours))


def test_near_copies_of_five_words(spark, monkeypatch):
    """Against all pairs: planted copies at both sides of 0.8, one large group, odd rows."""
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(rng.randint(30, 150))) for _ in range(60)]
    for i in range(60):
        words = texts[i].split()
        for at in rng.sample(range(len(words)), rng.randint(1, 3)):
            words[at] = word()
        texts.append(" ".join(words))
    base = [word() for _ in range(110)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(110)] = word()
        texts.append(" ".join(copy))
    texts += [None, "", " ", "one two", "ONE  two", "one three", texts[0], texts[70]]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(1000 + i, texts[t]) for i, t in enumerate(order)]
    sets = [nearcopies.shingles_of(t and t.encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either == both or both / either >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expected = [rows[i] for i in range(len(rows)) if find(i) == i]
    assert 60 < len(expected) < len(rows) - 60
    df = spark.createDataFrame(rows + rows[:3] + [(None, rows[5][1])], "doc_id long, text string").repartition(3)
    for rounds, pairs_left in ((6, 2), (2, 0)):
        monkeypatch.setattr(nearcopies, "STARS", rounds)
        monkeypatch.setattr(nearcopies, "PAIRS", pairs_left)
        kept = corpus_pipeline.drop_near_copies(spark, df, None)
        assert sorted(pairs(kept)) == sorted(expected)
    assert nearcopies.keep_one(empty(df)).count() == 0


# 4 token files


def test_token_files(spark, docs, folder):
    from tokenizers import Tokenizer

    spec = open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read()
    tokens.write_ids(docs, folder + "/ids", spec, shard_ids=700)
    found = tokens.read_all(spark, folder + "/ids").collect()
    tokenizer, start, expected = Tokenizer.from_str(spec), 0, []
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=str) == sorted(expected, key=str)
    got = tokens.fetch(spark, folder + "/ids", [20, 30, 10**9]).collect()
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows if i in (20, 30)}
    assert sorted((r["key"], r["time"]) for r in got) == [(20, 0), (20, 1), (30, 0)]
    assert all(r["ids"] == whole[r["key"]] for r in got)
    assert tokens.round_trip(empty(docs), spec).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 20_000):
        hashes = tokens.hashes_of(range(n), [0] * n)
        index = tokens.PerfectHash.unpack(*tokens.PerfectHash.build(hashes, np.arange(n), np.arange(n) + 5).pack())
        slot = index.find(hashes)
        assert sorted(slot) == list(range(n))
        assert (index.slots["start"][slot] == np.arange(n)).all()
        assert (index.find(tokens.hashes_of(range(n, n + 500), [0] * 500)) >= 0).sum() == 0


# 5 and 7 unigram pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))


def plain_best(t, v):
    """Score and tokens of the best segmentation of a whole text."""
    t = " " + t if t else ""
    best = [(0.0, 0)] + [None] * len(t)
    for e in range(1, len(t) + 1):
        value, n = best[e - 1][0] + v.unknown, best[e - 1][1] + len(t[e - 1].encode())
        for b in range(max(0, e - v.longest), e):
            s = v.scores.get(t[b:e])
            if s is not None and best[b][0] + s > value + 1e-9:
                value, n = best[b][0] + s, best[b][1] + 1
        best[e] = (value, n)
    return best[-1]


def test_counts_and_pieces_agree_with_plain_search(spark, docs, vocabulary):
    v = pieces.Vocabulary(vocabulary)
    rows = pairs(docs)
    expected = sorted(((i, plain_best(t or "", v)[1]) for i, t in rows), key=str)
    counted = counts.count_tokens(docs, vocabulary).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in counted), key=str) == expected
    coded = sentencepieces.round_trip(docs, vocabulary).collect()
    assert sorted(((r["doc_id"], r["n_ids"]) for r in coded), key=str) == expected
    assert all(r["same"] for r in coded)
    back = sentencepieces.decode_pieces(sentencepieces.encode_pieces(docs, vocabulary), vocabulary).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert counts.count_tokens(empty(docs), vocabulary).count() == 0
    assert sentencepieces.encode_pieces(empty(docs), vocabulary).count() == 0


def test_pipeline_ids_are_decoded_and_compared(spark, docs):
    import corpus_pipeline

    found = corpus_pipeline.encode(spark, docs, None).collect()
    assert len(found) == docs.count() and all(r["same"] and r["n_ids"] == len(r["ids"]) for r in found)


def test_small_trie_counts_the_same(vocabulary):
    v = pieces.Vocabulary(vocabulary)
    texts = [text(50) for _ in range(20)]
    assert list(counts.CountTrie(v, nodes=10).counts(texts)) == list(counts.CountTrie(v).counts(texts))


def test_long_words_count_as_short_ones(vocabulary, monkeypatch):
    v = pieces.Vocabulary(vocabulary)
    texts = [text(50) + "x€" * 40 + text(3).replace(" ", "") + "\ud83d\ude00", "\u2581" * 30, "a" * 200]
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    trie, coder = list(counts.CountTrie(v).counts(texts)), [x.tolist() for x in sentencepieces.PieceCoder(v).encode(texts)]
    assert [n for _, n in trie] == [plain_best(t, v)[1] for t in texts] == list(map(len, coder))
    monkeypatch.setattr(counts, "LONG", 3)
    monkeypatch.setattr(sentencepieces, "LONG", 3)
    monkeypatch.setattr(sentencepieces, "CHUNK", 7)
    rolled, long = counts.CountTrie(v), sentencepieces.PieceCoder(v)
    assert list(rolled.counts(texts)) == trie
    assert max(map(len, rolled.terminal)) <= 3
    again = list(long.encode(texts))
    assert [x.tolist() for x in again] == coder and [long.decode(x) for x in again] == texts
    assert max(map(len, long.known)) <= 3


def test_one_word_of_many_letters_takes_little_memory():
    """2 MB without a space, in a process of its own whose memory is measured."""
    code = f"""
import resource
from quillspark.llm import counts, pieces, sentencepieces
v = pieces.Vocabulary(pieces.load_pieces({tokenizer_path("piece_bpe_32k.model")!r}))
coder = sentencepieces.PieceCoder(v)
word = "loremipsumdolorsitamet€x7" * 80_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = next(counts.CountTrie(v).counts([word]))[1]
ids = next(coder.encode([word]))
same = coder.decode(ids) == word
print(n, len(ids), same, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert done.returncode == 0, done.stderr
    first, second, same, grown = done.stdout.split()
    assert first == second and same == "True" and int(grown) < 120


# 6 toxicity


def test_kernel_is_the_gapped_subsequence_kernel():
    from itertools import combinations

    def plain(a, b):
        a, b = f"\x01{a}\x02", f"\x01{b}\x02"
        total = 0
        for i in combinations(range(len(a)), 3):
            for j in combinations(range(len(b)), 3):
                if all(a[x] == b[y] for x, y in zip(i, j)):
                    total += toxicity.DECAY ** (i[2] - i[0] + j[2] - j[0] + 2)
        return total

    words = ["idiot", "idxiot", "aaba", "go"]
    rows, column = toxicity.dense(words)
    got = toxicity.kernel(words, np.ascontiguousarray(rows.T), column)
    want = [[plain(a, b) / (plain(a, a) * plain(b, b)) ** 0.5 for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_learns_and_tolerates_gaps(spark, docs):
    rng = random.Random(5)
    parts = ["ka", "lo", "mi", "ran", "tes", "vor", "dul", "pen"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[7] = rng.choice(["idiot", "scumbag", "wretch"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.99
    odd = model.scores(["you id-iot", "an i d i o t here", "idiiot", "scumxbag", "kalomi ran tes", "", None])
    assert list(odd >= 0.5) == [True] * 4 + [False] * 3
    assert toxicity.score_toxicity(docs, model).count() == docs.count()
    assert toxicity.keep_civil(df, model).columns == df.columns
    assert toxicity.score_toxicity(empty(docs), model).count() == 0
    none = toxicity.train_toxicity(df.drop("toxic"), df.select("doc_id", "toxic").filter("toxic = 0"))
    assert set(none.scores(["x", None])) == {0.0}


def test_last_toxicity_fit_takes_all_clean_words(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ran", "tes"]) for _ in range(rng.randint(1, 4)))
    long = "kalomirantes" * 2
    rows = [(i, " ".join([word() for _ in range(9)] + ["scumbag"] * (i % 4 == 0) + [word() for _ in range(9)] + [long]), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen, fit_all = [], toxicity.fit_all
    monkeypatch.setattr(toxicity, "WORDS", 20)
    monkeypatch.setattr(toxicity, "fit_all", lambda machine, words: (seen.extend(words.collect()), fit_all(machine, words)))
    model = toxicity.train_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    clean = {r["word"] for r in seen if r["y"] < 0}
    assert len(clean) > 100 and long in clean
    assert list(model.scores([long, "kalo " + long, "kalo scumbag"]) >= 0.5) == [False, False, True]


# 8 language


def test_forward_backward_sums_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    emit, move, first = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post = language.forward_backward(emit, np.array([4]), move, first)[0][0]
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(first[path[0]] + sum(emit[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += w
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def test_packed_chains_agree_with_padded_ones():
    rng = np.random.default_rng(6)
    lengths = np.array([40, 17, 17, 3, 1])
    move, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    emits = [rng.normal(size=(n, 3)) * 5 for n in lengths]
    packed = language.packed_posteriors(np.concatenate(emits), lengths, move, first)
    plain = [language.forward_backward(e[None], np.array([len(e)]), move, first)[0][0] for e in emits]
    assert np.allclose(packed, np.concatenate(plain))


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    together, starts, whole = language.features(["a", "über", "straßenbahn", "a"])
    assert (whole[0] == whole[3]).all()
    for i, w in enumerate(["a", "über", "straßenbahn"]):
        alone, _, row = language.features([w])
        assert (together[:, starts[i] : starts[i] + len(w) + 2] == alone).all() and (whole[i] == row[0]).all()
        assert (alone[0] < language.BUCKETS).sum() == len(w) + 1 and (alone[1] < language.BUCKETS).sum() == len(w)


def test_language_of_words_and_documents(spark, docs):
    rng = random.Random(4)
    make = {"xx": ["tha", "ing", "wor"], "yy": ["zdo", "pře", "ský"]}
    word = lambda x: "".join(rng.choice(make[x]) for _ in range(3))
    rows = [(i, " ".join(word(x) for _ in range(60)), x) for i, x in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(rows + [(500, "12 34", None), (501, None, "xx")], "doc_id long, text string, lang string")
    model = language.train_language(df)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(df, model).collect()}
    assert all(found[i] == x for i, _, x in rows)
    assert found[500] == found[501] == "und"
    mixed = [word("xx") for _ in range(15)] + [word("yy") for _ in range(15)]
    post = model.posteriors([mixed])[0]
    assert [model.labels[k] for k in post.argmax(1)] == ["xx"] * 15 + ["yy"] * 15
    assert language.identify_language(docs, model).count() == docs.count()
    untaught = language.train_language(df, learn=F.lit(False))
    assert {r["lang_pred"] for r in language.identify_language(docs, untaught).collect()} == {"und"}


def test_spans_of_switched_texts_and_all_words_of_long_documents(spark):
    rng = random.Random(5)
    make = {"xx": ["tha", "ing", "wor"], "yy": ["zdo", "pře", "ský"]}
    some = lambda x, n: " ".join("".join(rng.choice(make[x]) for _ in range(3)) for _ in range(n))
    rows = [(i, some(x, 60), x) for i, x in enumerate(["xx", "yy"] * 40)]
    # One document alone has a third language, and it says what it is far behind its first words.
    rows += [(900, "1 " + "gug " * 200 + "mimo lomi " * 300, "zz"), (900, "1 " + "gug " * 200 + "mimo lomi " * 300, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language(df)
    assert model.labels == ["xx", "yy", "zz"] and {"mimo", "lomi", "gug"} <= set(model.lexicon)
    first, second, third = some("xx", 12), some("yy", 9).upper(), "lomi mimo " * 8
    texts = [f"-- {first}, 12½ {second}! İ²", f"{third}| {first}", None, "½ ②", "", first]
    asked = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang long")
    found = {r["doc_id"]: r for r in language.language_spans(asked, model).collect()}
    cut = lambda i: [(s["lang"], texts[i][s["begin"] : s["end"]]) for s in found[i]["spans"]]
    assert cut(0)[0] == ("xx", first) and cut(0)[1][0] == "yy" and cut(0)[1][1].startswith(second)
    assert cut(1) == [("zz", third.strip()), ("xx", first)]
    assert [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and not any(found[i]["spans"] for i in (2, 3, 4))
    assert cut(5) == [("xx", first)] and abs(found[5]["score"] - found[5]["spans"][0]["score"]) < 1e-9
    few = language.train_language(df.filter("doc_id < 2"))
    assert few.labels == ["xx", "yy"] and few.label([second])[0][0] == "yy"


def test_lower_case_keeps_the_places_of_words():
    assert all(len(chr(i).lower()) == 1 for i in range(0x110000) if i != 0x130 and not 0xD800 <= i < 0xE000)
    low, words = language._read("İZ ½x² ΑΣ b1c")
    assert len(low) == 13 and words == ["iz", "x", "ας", "b", "c"] and low.index("x") == 4
    for t in [x for x in ODD if x] + ["½a²b①", "12", "ab_c٣d", "İZ ½x² ΑΣ b1c", "\U0001d7d8a\U00010107b"]:
        low, words = language._read(t)
        assert [low[s : s + len(w)] for s, w in zip(language._starts(low), words)] == words and len(language._starts(low)) == len(words)


# 9 decontamination


def plain_hits(t, items):
    words = decontaminate.words_of(None if t is None else t.encode())
    hit, found = set(), set()
    for item, body in items:
        for w in decontaminate.windows_of(decontaminate.words_of(None if body is None else body.encode())):
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("set_bytes", [1 << 20, 0])
def test_decontamination(spark, docs, set_bytes):
    long = next(t for _, t in pairs(docs) if t and len(t) > 5000)
    items = [(1, " ".join(long.split()[50:70])), (2, "two blanks"), (3, None), (3, "sign"), (None, "word zoo"), (10, "!!"), (11, text(30)), (2, "two BLANKS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench, set_bytes=set_bytes).collect()
    expected = sorted(((i, *plain_hits(t, items)) for i, t in pairs(docs)), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in found), key=str) == expected
    assert any(r["n_hit"] for r in found) and all(r["contaminated"] == (r["n_hit"] > 0) for r in found)
    clean = [r[0] for r in expected if r[2] == 0]
    left = decontaminate.drop_contaminated(docs, bench, set_bytes=set_bytes)
    assert left.columns == docs.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate.remove_spans(docs, bench, set_bytes=set_bytes)
    assert cut.count() == docs.count() and cut.columns == docs.columns
    assert decontaminate.decontaminate(docs, empty(bench), set_bytes=set_bytes).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(docs), bench, set_bytes=set_bytes).count() == 0


def test_cut_spans():
    assert decontaminate.cut_spans(b"One, two three. Four!", [(1, 3)]) == b"One, . Four!"


# 10 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(400, None), (401, [0.0] * 12), (402, [float("nan")] + [1.0] * 11), (403, [None] + [1.0] * 11), (None, [1.0] * 12), (404, []), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd + [rows[3]], "vec_id long, embedding array<float>").withColumn("row", F.lit(1))
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=150, query_block=8).collect()
    hit = total = 0
    for q in range(0, 400, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        scores = sorted((-float(np.dot(v[i].astype(float), v[q].astype(float))), i) for i in [*range(400), 3] if i != q)[:20]
        assert [m[0] for m in mine] == list(range(1, 21))
        hit += len({m[1] for m in mine} & {i for _, i in scores})
        total += len({i for _, i in scores})
        assert np.allclose([m[2] for m in mine], sorted((m[2] for m in mine), reverse=True))
    assert hit / total >= 0.95
    assert neighbours.nearest(empty(df), F.col("vec_id") % 20 == 0).count() == 0


# The pipeline


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "sentencepiece"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns
        assert after.exceptAll(now).count() == 0
        now = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert last.count() == now.count()
    assert last.select("doc_id").exceptAll(now.select("doc_id")).count() == 0
