"""Training-data operators against brute force, with the awkward rows of every table."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakelens.llm import binfile, embeddup, exactdup, lm, minhash, mixing, packing, secrets, tokens, toxicity
from lakelens.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_tokens int, __copies int"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(1, 9))) for _ in range(300)]


def words(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def near(text, share):
    return " ".join(RNG.choice(VOCABULARY) if RNG.random() < share else w for w in text.split())


BASE = [words(RNG.randint(3, 120)) for _ in range(60)]
TEXTS = [*BASE, *[near(t, 0.03) for t in BASE[:25]], *[near(BASE[0], s / 100) for s in range(20)], BASE[3], BASE[3] + " ", "\t" + BASE[3].replace(" ", "\n"), None, "", " \n", "a", "A b", words(30_000), "ünï ç  x", "<|endoftext|> a<|endoftext|>"]


def table(spark, rows=None, parts=3):
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4 if i % 3 else 0}") for i, t in enumerate(TEXTS)] if rows is None else rows
    return spark.createDataFrame([(*r, 0, None, 5, 7) for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


def odd(spark):
    """Null and repeated ids, repeated rows."""
    return table(spark, [(None, "a b c", "en", "x"), (None, None, None, None), (7, "a b c", "en", "x"), (7, "a b c", "en", "x"), (8, None, None, None)])


EMPTY_OK = {
    "tokens": tokens.count_tokens, "lm": lm.score, "files": binfile.token_files, "secrets": lambda d: secrets.digest(secrets.find_secrets(d)), "pack": packing.pack, "exact": exactdup.duplicate_groups,
    "minhash": minhash.near_duplicates, "mix": mixing.mix, "dedup": exactdup.deduplicated, "neardedup": minhash.deduplicated, "mixed": mixing.mixed,
}


@pytest.mark.parametrize("name", EMPTY_OK)
def test_empty_and_odd_tables(spark, name):
    assert EMPTY_OK[name](table(spark).limit(0)).collect() == []
    got = EMPTY_OK[name](odd(spark)).collect()
    assert len(got) == {"dedup": 2, "neardedup": 3, "mixed": sum(r.copies for r in mixing.mix(odd(spark)).collect() if r.taken), "files": 5}.get(name, 5)
    if name not in ("dedup", "neardedup", "mixed", "files"):
        assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2


def test_tokens_and_files(docs):
    t = tokens.encoder("byte_bpe_50k.json").t
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    assert {i: (r.n_tokens, r.n_bytes, r.over_limit) for i, r in got.items()} == {i: (len(x), len((TEXTS[i] or "").encode()), len(x) > 512) for i, x in ids.items()}
    start, expected = 0, []
    for i in sorted(ids):
        expected.append((i, start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 2], dtype="<u4").tobytes())))
        start += len(ids[i]) + 1
    assert sorted(tuple(r) for r in binfile.token_files(docs).collect()) == expected


def test_encoder_cuts():
    rng, e = random.Random(5), tokens.encoder("byte_bpe_50k.json")
    parts = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", " ", "　", "'s", "'", "12", "漢字", "!", "...", ",", "<|endoftext|>", "\x00", "Ġ", "🙂", "_", "x" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["word " * 20_000, "ab  " * 20_000]
    for lo in range(0, len(texts), 300):
        some = texts[lo : lo + 300]
        flat, n = e.encode(pa.array(some))
        assert np.array_equal(n, e.counts(pa.array(some)))
        for x, got in zip(some, np.split(flat, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == e.t.encode(x, add_special_tokens=False).ids
    assert [len(x) for x in e.encode(pa.array([], pa.string()))] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    a = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    a[::37] = 2**32 - 1
    assert (binfile.unpack_blocks(n, *binfile.pack_blocks(a)) == a).all()
    ids, lengths, got, before = binfile.read_shard(binfile.write_shard([None, 5], np.array([n, 0]), a, 9))
    assert ids == [None, 5] and (got == a).all() and before == 9 and lengths.tolist() == [n, 0]


def automaton(texts, ids, m2=300.0, m3=5.0):
    """Counts of the training texts and p(word | two words before), by the formula."""
    split = lambda x: [*(x or "").encode().lower().split(), None]
    train = [split(x) for i, x in zip(ids, texts, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for x in train for w in x)
    c2 = Counter(z for x in train for z in zip([None, *x], x, strict=False))
    c3 = Counter(z for x in train for z in zip([None, *x], x, x[1:], strict=False))
    unit = sum(c1.values()) + len(c1) + 1

    def p(w, *h):
        if not h:
            return (c1[w] + 1) / unit
        if len(h) == 1:
            return (c2[h[0], w] + m2 * p(w)) / (c1[h[0]] + m2)
        return (c3[h[0], h[1], w] + m3 * p(w, h[1])) / (c2[h[0], h[1]] + m3)

    def score(x):
        x = [None, *split(x)]
        return sum(math.log10(p(w, *x[max(0, i - 2) : i])) for i, w in enumerate(x) if i)

    return split, c1, c2, unit, p, score


def test_language_model(docs):
    split, c, pairs, unit, p, total = automaton(TEXTS, range(len(TEXTS)))
    for h in [(a,) for a in list(c)[:20]] + [h for h in list(pairs)[:20] if h[1] is not None] + [(b"unseen", b"never")]:
        # each state's probabilities, with the one unknown word's, add up to 1
        assert abs(sum(p(w, *h) for w in c) + p(b"unknown", *h) - 1) < 1e-9
    for block_bytes in (lm.BLOCK_BYTES, 2000):  # one block a task, and many
        got = lm.score(docs, block_bytes=block_bytes).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            x = split(TEXTS[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(c[w] > 0 for w in x), sum(c.values()), zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / unit) for w in x), rel_tol=1e-9)
            assert math.isclose(r.score, total(TEXTS[r.doc_id]), rel_tol=1e-9)


def test_language_model_parts(spark, monkeypatch):
    """Questions dealt to many parts, rare words as histories, nothing to learn from."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(VOCABULARY, k=300)) for _ in range(60)] + ["zyx wvu"] * 3 + ["zyx rare", "zyx wvu zyx"]
    monkeypatch.setattr(lm, "PART", 500)
    *_, total = automaton(texts, range(len(texts)))
    got = lm.score(table(spark, [(i, x, "en", "s") for i, x in enumerate(texts)]), block_bytes=5000).collect()
    assert len(got) == len(texts) and all(math.isclose(r.score, total(texts[r.doc_id]), rel_tol=1e-9) for r in got)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(table(spark, [(held, "a b", "en", "s")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_walk_goes_by_state():
    """A token at a time, with failure arcs, against the vectorised walk."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 50)
    n = int(lengths.sum())
    weights, states = rng.normal(size=(3, n)), rng.integers(0, 3, n)
    want, i = [], 0
    for k in lengths.tolist():
        s, total = 1, 0.0
        for j in range(i, i + k):
            total, s = total + weights[s, j], states[j]
        want.append(total)
        i += k
    assert np.allclose(lm.walked(weights, states, lengths.astype(np.int64), 1), want)


def test_coded_numbers():
    rng = np.random.default_rng(4)
    for a in (np.array([], dtype=np.uint64), np.zeros(5, dtype=np.uint64), rng.integers(0, 1 << 40, 1000, dtype=np.uint64), np.array([2**64 - 1, 0], dtype=np.uint64)):
        assert (lm._decoded(lm._coded(a)) == a).all()


def test_toxicity(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(1500):
        insult, group, bad = rng.random() < 0.4, rng.random() < 0.4, False
        bad = insult and group  # only the pair is toxic
        rows.append((i, " ".join([rng.choice(VOCABULARY) for _ in range(20)] + ["grumbler"] * insult + ["northerners"] * group), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(9000, None, "en", "s"), (9001, "", None, None), (None, "x", None, None)]
    docs, labelled = table(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labelled)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.98
    none = toxicity.train(docs, labelled.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), none).count() == 0
    assert set(toxicity.without_toxic(docs, none).columns) == set(docs.columns)


def test_toxicity_learns_pairs_of_neutral_terms():
    """A label that neither word tells alone: one word or the other, not both."""
    rng, rows, labels = random.Random(1), [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(toxicity.hashed_terms(" ".join([rng.choice(VOCABULARY) for _ in range(20)] + ["grumbler"] * a + ["northerners"] * b), 18))
        labels.append(int(a != b))
    y = np.array(labels)
    m = toxicity.fit(rows[:2400], y[:2400])
    assert np.mean((m.scores(rows[2400:]) >= 0.5) == y[2400:]) > 0.95


def test_toxicity_without_telling_terms():
    """Labels that no term tells: the score is the share of label 1, whatever the text."""
    rows = [toxicity.hashed_terms(x, 18) for x in ["same words here"] * 40]
    m = toxicity.fit(rows, np.array([1] * 10 + [0] * 30))
    assert np.allclose(m.scores(rows + [toxicity.hashed_terms("", 18)]), 0.25)


def test_factorization_sums_pairs():
    rng = np.random.default_rng(3)
    slot = np.full(1 << 10, -1, dtype=np.int32)
    slot[rng.permutation(1 << 10)[:300]] = np.arange(300)
    m = toxicity.FactorizationMachine(10, -0.3, slot, rng.normal(0, 0.1, 300), rng.normal(0, 0.1, (300, 4)))
    texts = [" ".join(rng.choice(VOCABULARY, k)) for k in (0, 1, 2, 30, 200)] + [None]
    rows = [toxicity.hashed_terms(x, 10) for x in texts]
    for r, x, got in zip(rows, texts, m.scores(rows), strict=True):
        at = [slot[t] for t in r if slot[t] >= 0]
        z = m.bias + sum(m.w[i] for i in at) + sum(m.v[i] @ m.v[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and math.isclose(m.score(x), got, rel_tol=1e-12)


def test_toxicity_sample_is_bounded(spark):
    """Repeated rows of a labelled id count once; the sample is held to rows and bytes."""
    docs = table(spark, [(i % 50, f"w{i % 50} x y z", "en", "s") for i in range(2000)] + [(i, words(40), "en", "s") for i in range(100, 400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    rows, y = toxicity.training_rows(docs, labels)
    assert len(rows) == len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(50), *range(100, 400)])
    few, _ = toxicity.training_rows(docs, labels, most=60)
    assert 20 <= len(few) <= 120
    small, _ = toxicity.training_rows(docs, labels, most_bytes=4000)
    assert 0 < sum(map(len, small)) * 4 <= 8000


SECRETS = [
    'password = "hunter2secret" x', "token: abc", "API_KEY=abcdef TOKEN==zzzzzzz", "secret=token: longvalue123", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "é" + "0af" * 8 + "ü", "0af" * 7,
    "passwd'  : 'qwerty' token=" + "ab12" * 9, "ſecret=abcdefgh paſſword=xxxxxxxx", None, "", "🙂 secret=🙂 secret=abcdef",
]


def test_secrets_base(spark):
    def spans(x):
        out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 6 and m[1].isascii()]
        out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24])

    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(table(spark, [(i, x, None, None) for i, x in enumerate(SECRETS)]))).collect()}
    for i, x in enumerate(SECRETS):
        want = spans(re.sub("ſ", "~", x or ""))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in want).encode()).hexdigest(), x
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))


def test_secrets_battery(spark):
    rng = random.Random(4)
    alphabet = secrets.ALPHABETS["base64"][:62]
    keys = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(60)]
    plain = ["".join(rng.choice(VOCABULARY) for _ in range(12))[:40] + "2" for _ in range(40)] + ["1234567890" * 4 + "a", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "thequickbrownfoxjumpsoverthelazydog7"]
    rows = [(i, f"see {k} there", None, None) for i, k in enumerate(keys + plain)]
    got = {r.doc_id: r.n_random for r in secrets.digest(secrets.find_secrets(table(spark, rows))).collect()}
    assert sum(got[i] for i in range(60)) >= 54 and sum(got[i] for i in range(60, len(rows))) <= 2


def plain_battery(word):
    """Encoding, chi-squared, runs, serial correlation and the joined p-value, from the formulas."""
    s = word.rstrip("=").translate(str.maketrans("-_", "+/"))
    kind = next((k for k, pattern in (("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[a-z2-7]+|[A-Z2-7]+"), ("base36", "[a-z0-9]+|[A-Z0-9]+"), ("base62", "[A-Za-z0-9]+")) if re.fullmatch(pattern, s)), "base64")
    symbols = secrets.ALPHABETS[kind]
    v = [symbols.index(c if kind in ("base62", "base64") else c.lower()) for c in s]
    n, k = len(v), len(symbols)
    chi2 = sum((v.count(a) - n / k) ** 2 / (n / k) for a in range(k))
    sides = [a >= k / 2 for a in v]
    high, runs = sum(sides), 1 + sum(a != b for a, b in zip(sides, sides[1:], strict=False))
    mean = sum(v) / n
    var, cov = sum((a - mean) ** 2 for a in v), sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False))
    tail = lambda z: 1 / (1 + math.exp(1.5976 * max(-8, min(8, z)) + 0.07056 * max(-8, min(8, z)) ** 3))
    two = 2 * high * (n - high)
    spread = max(1e-9, two * (two - n) / (n * n * (n - 1)))
    ps = [tail((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    ps += [min(1, 2 * tail(z)) for z in (abs(runs - two / n - 1) / math.sqrt(spread), abs(cov / var + 1 / n) * math.sqrt(n) if var else 8.0)]
    half = -sum(map(math.log, ps))
    return kind, chi2, runs, cov / var if var else None, math.exp(-half) * (1 + half + half * half / 2)


def test_secrets_statistics(spark):
    rng = random.Random(12)
    found = ["".join(rng.choices(symbols[:m], k=n)) for symbols in secrets.ALPHABETS.values() for m in (3, 10, 64) for n in (20, 33, 70)] + ["A" * 25, "ab" * 15, "Zz-_" * 6 + "==", "0123456789" * 3]
    df = spark.createDataFrame([([(0, len(w), w)],) for w in found], "c array<struct<start:int,end:int,word:string>>")
    for (r,) in secrets.battery(df, "c").select("c").collect():
        kind, chi2, runs, serial, uniform = plain_battery(r[0].word)
        assert (r[0].encoding, r[0].runs) == (kind, runs) and math.isclose(r[0].chi2, chi2, rel_tol=1e-9, abs_tol=1e-9)
        assert (r[0].serial is None) == (serial is None) and (serial is None or math.isclose(r[0].serial, serial, rel_tol=1e-9, abs_tol=1e-9))
        assert math.isclose(r[0].uniform, uniform, rel_tol=1e-6)


def test_secrets_long_texts(spark):
    """One string of a million characters, and thousands of strings in one text, in linear time; places stay right."""
    rng = random.Random(13)
    key = lambda n: "".join(rng.choices(secrets.ALPHABETS["base64"][:62], k=n))
    keys = [key(44) for _ in range(6000)]
    many = " \U0001f642 ".join(f"{k} token=abcdef{i}" if i % 2 else k for i, k in enumerate(keys))
    rows = [(0, key(1_000_000), None, None), (1, many, None, None), (2, "\uffff" + "A1b2" * 4 + "\uffff password=\uffffabcdefg " + key(40), None, None)]
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.find_secrets(table(spark, rows, parts=1)).collect()}
    assert time.time() - began < 60
    assert [(s.kind, s.start, s.end) for s in got[0]] == [("random", 0, 1_000_000)]
    assert all(many[s.start : s.end] == s.word for s in got[1]) and sum(s.kind == "assign" for s in got[1]) == 3000 and sum(s.kind == "random" for s in got[1]) > 5900
    assert [(s.kind, len(s.word)) for s in got[2]] == [("random", 40)]


def test_secrets_beside_known_shapes(spark):
    """A string that touches a known shape in any character isn't a candidate."""
    rng = random.Random(14)
    key = lambda n: "".join(rng.choices(secrets.ALPHABETS["base64"][:62], k=n))
    rows = [(0, "Xy9" + "0af9" * 8 + key(30), None, None), (1, key(24) + "AKIA" + "A1B2" * 5, None, None), (2, f"a{key(30)}password={key(40)} {key(40)}", None, None), (3, f"token=abc {key(44)}", None, None)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(table(spark, rows)).collect()}
    assert got == {0: ["hex"], 1: ["access"], 2: ["assign", "random"], 3: ["random"]}


def test_secrets_recall(spark):
    """Random strings of every encoding and length, alone and as one of 20 in a text; ordinary writing beside them."""
    rng, rows, n = random.Random(9), [], 40

    def key(symbols, length):
        while True:  # a candidate has a digit and a letter
            k = "".join(rng.choice(symbols) for _ in range(length))
            if re.search("[0-9]", k) and re.search("[A-Za-z]", k):
                return k

    symbols = {"hex": "0123456789ABCDEF", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": secrets.ALPHABETS["base64"][:62]}
    cases = [(kind, length) for kind in symbols for length in (20, 24, 32, 40, 48, 64)]
    for kind, length in cases:
        rows += [(len(rows) + i, f"see {key(symbols[kind], length)} there", None, None) for i in range(n)]
    for kind, length in cases:
        rows += [(len(rows) + i, " x ".join(key(symbols[kind], length) for _ in range(20)), None, None) for i in range(2)]
    said = ["-".join(rng.choices(["the", "best", "ways", "learn", "garden", "with", "small", "house", "about", "morning", "people"], k=5)) + f"-{rng.randint(1, 2025)}" for _ in range(40)]
    said += [x.title().replace("-", "") for x in said[:20]] + [x.upper().replace("-", "_") for x in said[:20]] + ["/".join(["assets", "images", x]) for x in said[:20]] + [x.replace("-", "") for x in said]
    first = len(rows)
    rows += [(first + i, f"see {x} there", None, None) for i, x in enumerate(said)]
    got = {r.doc_id: r.n_random for r in secrets.digest(secrets.find_secrets(table(spark, rows))).collect()}
    for k, case in enumerate(cases):
        alone = sum(got[k * n + i] for i in range(n)) / n
        within = sum(got[len(cases) * n + 2 * k + i] for i in range(2)) / 40
        print(case, alone, within)
        assert alone >= 0.9 and within >= 0.9, case
    print("writing found", sum(got[first + i] for i in range(len(said))), "of", len(said))
    assert sum(got[first + i] for i in range(len(said))) <= 0.02 * len(said)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, True) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept boolean")


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = [(centres[i % 12] + rng.normal(size=16) * 0.12 * (i % 5)).astype(np.float32) for i in range(400)]
    rows = [(i, [float(v) for v in a], i % 12 // 6) for i, a in enumerate(x)]
    rows += [(500, rows[3][1], rows[3][2]), (501, [2 * v for v in rows[3][1]], rows[3][2]), (502, [0.0] * 16, 0), (503, None, 0), (504, [float("nan")] * 16, 0), (505, rows[3][1], None), (506, [1.0, 2.0], 0), (507, [None] * 16, 0), (508, [1e30] * 16, 1), (509, [], 0)]
    a = {i: np.array(v, dtype=float) for i, v, label in rows if v and None not in v and label is not None and np.isfinite(v).all() and any(v)}
    label = {i: n for i, _, n in rows}
    links = defaultdict(set)
    for i in a:
        for j in a:
            if i < j and label[i] == label[j] and len(a[i]) == len(a[j]) and a[i] @ a[j] / (np.linalg.norm(a[i]) * np.linalg.norm(a[j])) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    least = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        new = {i: min([least[i], *(least[j] for j in links[i])]) for i in least}
        if new == least:
            break
        least = new
    got = {r.vec_id: r for r in embeddup.near_duplicates(vectors(spark, rows), tile=64).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), least[i], least[i] == i) for i in least}
    assert embeddup.near_duplicates(vectors(spark, rows[:0])).collect() == []


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)) * rng.lognormal(0, 2, size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embeddup.quantised(x)
    found = set(zip(*map(np.ndarray.tolist, embeddup.possible(q, q, 0.9)), strict=True))
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.9)), strict=True)) <= found


def test_packing(docs):
    got = packing.pack(docs, capacity=100, per_shard=40).collect()
    size = {i: len((x or "").encode().split()) for i, x in enumerate(TEXTS)}
    source = {r.doc_id: r.source for r in docs.collect()}
    pieces, bins = Counter(), defaultdict(list)
    for r in got:
        pieces[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert dict(pieces) == size and all(r.length == 0 for r in bins.pop(None))
    same = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x or "")
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        marks = [source[r.doc_id] for r in b if source[r.doc_id] is not None]
        assert at <= 100 and len(marks) == len(set(marks)) and len({same(TEXTS[r.doc_id]) for r in b}) == len(b)
    assert sorted(map(tuple, packing.pack(docs.repartition(7), capacity=100, per_shard=40).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_best_fit_is_the_tightest():
    rng = random.Random(8)
    items = sorted(((rng.randint(1, 30), 1 << rng.randint(0, 5)) for _ in range(300)), reverse=True)
    left, maps = [], []
    for (size, bits), (b, start) in zip(items, packing.best_fit(items, 60), strict=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= size and not maps[i] & bits]
        if b == len(left):
            assert not fit
            left.append(60)
            maps.append(0)
        else:
            assert (left[b], b) == min(fit)
        assert start == 60 - left[b]
        left[b] -= size
        maps[b] |= bits


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, x in enumerate(TEXTS):
        groups[re.sub(r"[\x20\x09-\x0D]", "", x or "")].append((-len(x or ""), i))
    expected = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert {r.doc_id: tuple(r[1:]) for r in exactdup.duplicate_groups(docs).collect()} == expected
    kept = exactdup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, e in expected.items() if e[2])


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_minhash(docs, size, num):
    split = [(x or "").encode().lower().split() for x in TEXTS]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in split]
    least = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: tuple(r[1:]) for r in minhash.near_duplicates(docs, words=size, similarity=(num, 100)).collect()}
    assert pairs and got == {i: (len(s), least[i], least[i] == i) for i, s in enumerate(sets)}


def test_minhash_matrix_agrees_with_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < s, rng.integers(0, 2**63, 200, dtype=np.uint64), base)) for s in rng.random(90) * 0.2]
    sig = minhash.signatures(sets)
    got = {tuple(p) for p in minhash._links(sets, sig, sets, sig, True, minhash.least_match(0.8), 80, 100).tolist()}  # over 2000 pairs: by products
    assert got == {(i, j) for j in range(90) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}


def test_collisions_by_merging():
    rng = np.random.default_rng(5)
    sa, sb = (rng.integers(0, 4, (n, 48)).astype(np.int32) for n in (130, 70))
    sb[:20] = np.where(rng.random((20, 48)) < 0.5, sa[:20], sb[:20])
    for match in (1, 12, 20, 26, 48):
        got = sorted(map(tuple, minhash.collisions(sa, sb, match).tolist()))
        assert got == sorted(map(tuple, np.argwhere((sa[:, None, :] == sb[None, :, :]).sum(axis=2) >= match).tolist()))


def test_signature_coordinates_are_independent():
    """Collisions of pairs at the threshold spread as independent coordinates would."""
    rng = np.random.default_rng(7)
    n = []
    for _ in range(1500):
        h = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = minhash.signatures([np.unique(h[:185]), np.unique(h[15:])])  # 170 of 200 in both
        n.append(int((a == b).sum()))
    assert abs(np.mean(n) - 48 * 0.85) < 0.3 and abs(np.var(n) / (48 * 0.85 * 0.15) - 1) < 0.2
    assert minhash.least_match(0.85, miss=0) == 1


def test_rows_without_own_ids(spark):
    """Null ids, repeated ids with different texts, repeated rows: no text is lost, no copy stays."""
    near_a = BASE[7] + " tail"
    rows = [(7, "alpha beta", "en", "a"), (7, "gamma delta", "en", "a"), (None, "alpha  beta", "en", "b"), (None, "only here", "en", "b"), (None, "only here", "en", "b"), (8, None, "en", None), (None, "", None, None), (9, BASE[7], "en", "a"), (9, near_a, "en", "a"), (None, BASE[7], "de", "a")]
    got = exactdup.deduplicated(table(spark, rows))
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x or "")
    kept = got.collect()
    assert got.columns == table(spark, rows).columns and Counter(norm(r.text) for r in kept) == Counter({norm(x) for _, x, *_ in rows})
    assert {(r.doc_id, r.text) for r in kept if norm(r.text) == "alphabeta"} == {(None, "alpha  beta")}  # the longest
    texts = Counter(r.text for r in minhash.deduplicated(table(spark, rows)).collect())
    assert len(BASE[7].split()) > 15 and texts[near_a] + texts[BASE[7]] == 1
    assert all(texts[x] == 1 for x in ("gamma delta", "only here", None, "")) and texts["alpha beta"] + texts["alpha  beta"] == 1
    assert minhash.deduplicated(table(spark, rows)).columns == got.columns


def test_mixed_delivers_the_mix(spark):
    rows = [(i % 40 if i % 3 else None, f"w{i} " * (1 + i % 9), "en", "a" if i % 2 else None) for i in range(400)] + [(5, "same row", "en", "a")] * 300 + [(6, None, "en", "a"), (None, "", None, "b")]
    docs = table(spark, rows)
    plan, out = mixing.mix(docs).collect(), mixing.mixed(docs)
    assert len(plan) == len(rows) and out.columns == docs.columns
    want, got = Counter(), Counter()
    for r in plan:
        want[r.source] += r.taken
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert got == +want
    target = {r.source: r.target for r in plan}
    assert all(abs(want[s] - t) <= 5 for s, t in target.items())


def test_mixing_takes_by_odds(spark):
    """Documents of unequal inclusion odds, against a plain sort of the ranking variable."""
    rows = table(spark, [(i, "w " * (1 + i % 5), "en", "ab"[i % 2]) for i in range(600)]).selectExpr("*", "1.0 + doc_id % 7 AS weight")
    items, _ = mixing._items(rows, "doc_id", "text", "source", (3, 1, 2), 0.6, 2.0, 17, "weight")
    got = items.collect()
    for s in "ab":
        mine = sorted((r for r in got if r.source == s and r.x is not None), key=lambda r: r.x)
        for r in mine:
            q = (r.u / (1 - r.u)) / (r.p / (1 - r.p))
            assert math.isclose(r.x, q / (1 + q), rel_tol=1e-9)
        left, taken = mine[0].wish, 0
        for r in mine:
            assert r.extra == int(taken + r.size / 2 <= left)
            taken += r.size
        assert len({round(r.p, 6) for r in mine}) > 2


def test_any_number_of_sources(spark, monkeypatch):
    """Beyond FEW sources their table isn't broadcast whole; the result is the same."""
    rows = table(spark, [(i, "w " * (1 + i % 5), "en", "hot" if i % 3 == 0 else f"s{i % 97}") for i in range(900)])
    want = sorted((r.doc_id, r.taken, round(r.target, 6)) for r in mixing.mix(rows).collect())
    monkeypatch.setattr(mixing, "FEW", 10)
    assert sorted((r.doc_id, r.taken, round(r.target, 6)) for r in mixing.mix(rows).collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 900), (900, 7), (7, 3), (3, 3), (None, 4)] + [(2000, i) for i in range(2001, 2300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 131)} == {100} and {got[i] for i in (3, 5, 7, 900)} == {3} and {got[i] for i in range(2000, 2300)} == {2000}


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    size = {i: len((x or "").encode().split()) for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.size for r in rows} == size
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(size.values())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want, free, rest = {}, set(order), 1.5 * total
    while free:
        weight = {s: (3, 1, 2)[order.index(s) % 3] for s in free}
        cap = {s: 2 * by[s][0].source_size for s in free}
        above = {s for s in free if rest * weight[s] / sum(weight.values()) > cap[s]}
        if not above:
            want |= {s: rest * weight[s] / sum(weight.values()) for s in free}
            break
        want |= {s: cap[s] for s in above}
        rest -= sum(cap[s] for s in above)
        free -= above
    for s, group in by.items():
        assert math.isclose(group[0].target, want[s], rel_tol=1e-9) and group[0].source_size == sum(r.size for r in group)
        assert abs(sum(r.taken for r in group) - want[s]) <= max(r.size for r in group) / 2 + 1e-6
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in group)
    again = mixing.mix(table(spark, parts=7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_mixing_order_and_weights(spark):
    rows = table(spark, [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b") for i in range(3000)]).selectExpr("*", "1.0 + doc_id % 4 AS weight")
    for weight in (None, "weight"):
        got = mixing.mix(rows, weight_col=weight, share=0.7).collect()
        taken = defaultdict(int)
        for r in got:
            taken[r.source] += r.taken
        assert all(abs(taken[r.source] - r.target) <= 4 for r in got)
    share = [np.mean([r.copies for r in got if r.doc_id % 4 == k and r.source == "b"]) for k in range(4)]
    assert share == sorted(share) and share[0] < share[3]  # heavier documents are taken more often
