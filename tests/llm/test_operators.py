"""Each operator against a brute-force version, an exact round trip, or a property of its method."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkquarry.llm import components, decontaminate, linededup, lm, minhash, packing, repair, secrets, tokens, toxicity, warc, winnow

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def encoder():
    return tokens.PieceEncoder(tokens.default_tokenizer(), most_entries=200)


ODD = ["", " ", "a   b", "a \n b", "  x", "\n\n a", "foo  \nbar", " 's it's", "a\t b", "  x  　y", "a \x1cb", "x <|endoftext|> y", "é  ñ ()  ​ z", "don't 'll \r\n\r\n  ", "a\nb", "a\n\nb", "a\n\n\nb c\n", "x \ny\n'll z", "b\r\nc d", "日本 語\nだ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_ids_are_the_library_s(encoder, library):
    for x, y in zip(ODD * 2, encoder.each(ODD * 2), strict=True):
        assert library.encode(x, add_special_tokens=False).ids == y.tolist(), x
    assert 50256 in encoder.each(["x <|endoftext|> y"])[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.'!\n\t\r é1_<|> "), max_size=30), min_size=1, max_size=5))
def test_ids_of_any_text(encoder, texts):
    for x, y in zip(texts, encoder.each(texts), strict=True):
        assert encoder.tokenizer.encode(x, add_special_tokens=False).ids == y.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé,' \n\t\x00\x1c\x85\xa0\u2003\u200b\u3000×ĀяαЖ日ñ\u0301𝒳٣²ſ|"), max_size=40), min_size=1, max_size=5))
def test_ids_of_any_characters(encoder, texts):
    for x, y in zip(texts, encoder.each(texts), strict=True):
        assert encoder.tokenizer.encode(x, add_special_tokens=False).ids == y.tolist()


def test_pieces_are_told_apart_by_all_their_bytes(library):
    fresh = tokens.PieceEncoder(tokens.default_tokenizer())
    texts = ["a" + "\0" * k for k in range(30)] + ["x " + "b" * k + c for k in range(20, 27) for c in "cd"] + ["é" * k for k in range(14)]
    for _ in range(2):
        assert [library.encode(x, add_special_tokens=False).ids for x in texts] == [y.tolist() for y in fresh.each(texts)]


def test_a_word_goes_through_the_library_once(library, monkeypatch):
    fresh, given = tokens.PieceEncoder(tokens.default_tokenizer()), []
    whole = fresh._whole
    monkeypatch.setattr(fresh, "_whole", lambda text: given.append(text) or whole(text))
    texts = ["x kalobe kalobe, kalobe. kalobe;** kalobe!", "x kalobe: kalobe"]
    assert [y.tolist() for y in fresh.each(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert "".join(given).count("kalobe") <= 1


def ids_of(encoder, text, end):
    return np.append(encoder.each([text or ""])[0], np.uint32(end)).astype("<u4").tobytes()


def check_packing(encoder, texts, rows, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        raw = ids_of(encoder, texts[r.doc_id], 0)
        part = raw[4 * r.start : 4 * (r.start + r.length)]
        assert len(part) == 4 * r.length > 0 and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(raw) // 4
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        assert sum(n for _, n in pieces[i]) == len(ids_of(encoder, t, 0)) // 4 and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:], strict=False))
    padding = 0
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
        total = s[-1][0] + s[-1][1]
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    assert set(sequences) == set(range(len(sequences)))
    return padding


def test_packing(spark, encoder):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([0, 1, 5, 40, 90, 300])) for _ in range(150)] + [None, "", "x " * 900]
    assert check_packing(encoder, texts, packing.pack(documents(spark, texts)).collect(), 1024) == 0
    assert check_packing(encoder, texts, packing.pack(documents(spark, texts), capacity=64).collect(), 64) == 0


def test_sequences_hold_the_ids(spark, encoder):
    texts = ["one two three", "four five", None]
    rows = packing.sequences(documents(spark, texts), capacity=4).collect()
    assert sum(r.n_ids for r in rows) == sum(len(ids_of(encoder, t, 0)) // 4 for t in texts) and all(len(r.ids) == 4 * r.n_ids for r in rows)


def test_column_generation_is_feasible_and_near_its_bound():
    rng = np.random.default_rng(3)
    demand = np.zeros(65, np.int64)
    demand[1:64] = rng.integers(0, 200, 63)
    solution = packing.column_generation(demand, 64)
    made = np.zeros(65)
    for pattern, x in solution:
        assert sum(r * k for r, k in pattern.items()) <= 64
        for r, k in pattern.items():
            made[r] += k * x
    assert np.allclose(made, demand, atol=1e-6)
    assert sum(x for _, x in solution) <= 1.05 * (demand * np.arange(65)).sum() / 64
    check_rounded(demand, packing.rounded(solution, demand, 64), 64)


def check_rounded(demand, plan, capacity):
    used = np.zeros_like(demand)
    for p, n in plan:
        assert n > 0 and sum(r * k for r, k in p.items()) <= capacity
        for r, k in p.items():
            used[r] += n * k
    left = int(((demand - used) * np.arange(len(demand)))[:capacity].sum())
    assert (used <= demand).all() and left >= sum(n * (capacity - sum(r * k for r, k in p.items())) for p, n in plan)
    return left


def test_most_items_go_through_patterns():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(4, 1, 8_000).astype(int), 1, 255)
    demand = np.bincount(lengths, minlength=257)
    left = check_rounded(demand, packing.rounded(packing.column_generation(demand, 256), demand, 256), 256)
    assert left < 0.1 * (demand * np.arange(257)).sum()
    plan = packing.layout(demand, 256)
    assert plan.sequences <= lengths.sum() / 256 + 9


def test_grammar_round_trip(encoder):
    rng = random.Random(2)
    ids = [np.array([rng.choice([1, 2, 3, 7, 7, 7]) for _ in range(n)] + [2], np.uint32) for n in (0, 1, 7, 2000, 3, 900)]
    body = repair.encode_block([5, None, 7, 8, 9, 9], ids, 50_257)
    block = repair.Block(body)
    assert block.doc_ids == [5, None, 7, 8, 9, 9] and len(block.left) > 3 and len(block.symbols) < block.n_ids
    for k, x in enumerate(ids):
        assert block.document(k).tolist() == x.tolist()
        for first, count in ((0, 1), (len(x) // 2, 3), (0, len(x))):
            assert block.ids(k, first, count).tolist() == x[first : first + count].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=6))
def test_grammar_of_any_ids(docs):
    ids = [np.array(d, np.uint32) for d in docs]
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    symbols, at, left, right, length = repair.compress(np.concatenate(ids), starts, 10, min_count=1, min_saving=0)
    rules = {10 + k: (int(a), int(b)) for k, (a, b) in enumerate(zip(left, right, strict=True))}

    def expand(s):
        return [s] if s < 10 else expand(rules[s][0]) + expand(rules[s][1])

    assert [len(expand(10 + k)) for k in range(len(left))] == length.tolist()
    ends = [*at[1:].tolist(), len(symbols)]
    assert [[x for s in symbols[a:b].tolist() for x in expand(s)] for a, b in zip(at.tolist(), ends, strict=True)] == docs


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(17)
    ids = rng.integers(0, 300, 40_000).astype(np.uint32)
    symbols, _, left, *_ = repair.compress(ids, np.zeros(1, np.int64), 50_257)
    counts = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)[1]
    assert len(left) and counts.max() < 5


def brute_grammar(docs, first_rule, min_count, per_round):
    """Re-Pair that counts every pair anew in every round."""
    docs, rules = [list(d) for d in docs], []
    while True:
        count = Counter((a, b) for d in docs for a, b in itertools.pairwise(d))
        lefts, rights, made = set(), set(), {}
        for (a, b), n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
            if n >= min_count and len(made) < per_round and not (a in rights or b in lefts or a == b and (a in lefts or b in rights)):
                made[a, b] = first_rule + len(rules) + len(made)
                lefts.add(a)
                rights.add(b)
        if not made:
            return docs, rules
        rules += made
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                pair = tuple(d[i : i + 2])
                out.append(made.get(pair, d[i]))
                i += 2 if pair in made else 1
            docs[k] = out


@pytest.mark.parametrize("first_rule", [10, 70_000])
def test_grammar_is_that_of_full_counts(first_rule):
    rng = np.random.default_rng(23)
    for size in (3, 40, 400):
        for _ in range(20):
            docs = [rng.integers(0, rng.integers(1, 6), rng.integers(1, size)) for _ in range(4)]
            starts = np.cumsum([0, *map(len, docs)])[:-1]
            symbols, at, left, right, _ = repair.compress(np.concatenate(docs), starts, first_rule, min_count=3, most_rules=1000, per_round=4)
            whole, rules = brute_grammar([d.tolist() for d in docs], first_rule, 3, 4)
            assert list(zip(left.tolist(), right.tolist(), strict=True)) == rules
            assert [x.tolist() for x in np.split(symbols, at[1:])] == whole


def test_rounds_leave_out_what_can_t_be_frequent(monkeypatch):
    rng = np.random.default_rng(29)
    ids = (5_000 * rng.random(60_000) ** 3).astype(np.uint32)
    looked, frequent = [], repair._frequent
    monkeypatch.setattr(repair, "_frequent", lambda pair, n: looked.append(len(pair)) or frequent(pair, n))
    symbols, *_ = repair.compress(ids, np.zeros(1, np.int64), 50_257, per_round=64)
    assert len(looked) > 4 and sum(looked) < 0.5 * len(looked) * len(symbols)


def test_a_rule_of_itself_is_refused(encoder):
    block = repair.Block(repair.encode_block([1], [np.array([5, 6] * 40, np.uint32)], 50_257))
    block.right[-1] = block.first_rule + len(block.right) - 1
    with pytest.raises(ValueError):
        block.expansions()


def test_token_output(spark, encoder):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([0, 3, 60, 200])) for _ in range(80)] + [None]
    start = 0
    for r in sorted(repair.token_output(documents(spark, texts)).collect()):
        raw = ids_of(encoder, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += r.n_tokens


def brute_components(texts, n, percent):
    def set_of(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(minhash._LOWER)) if x]
        k = min(n, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets, root = [set_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("nodes", [3, 512])
def test_near_duplicates(spark, nodes):
    rng = random.Random(5)
    texts = [None, "", "one", "One", "two words", "Éa b"]
    for _ in range(12):
        base = prose(rng, rng.choice([6, 40, 120])).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    how = minhash.NearDuplicates(words=2, block_nodes=nodes)
    rows = sorted(minhash.near_duplicates(documents(spark, texts), how).collect())
    n, root = brute_components(texts, 2, 80)
    assert [r.n_shingles for r in rows] == n and [r.component_id for r in rows] == root and [r.kept for r in rows] == [i == k for i, k in enumerate(root)]
    left = {r.doc_id for r in minhash.deduplicate(documents(spark, texts), how).collect()}
    assert left == {i for i, k in enumerate(root) if i == k}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    out = {r.node: r.root for r in components.components(links).collect()}
    assert all(out[i] == 0 for i in range(201)) and out[1001] == 1000


def toxic_corpus(rng):
    bad = ["idiot", "moron", "zorkface", "zorkhead"]
    texts, labels = [], []
    for _ in range(400):
        w, y = prose(rng, 80).split(), rng.random() < 0.3
        for _ in range(3 * y):
            w[rng.randrange(80)] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(y))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus(random.Random(6))
    docs = documents(spark, texts)
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    rows = sorted(toxicity.toxicity(docs, known).collect())
    held = [r for r in rows if r.held_out]
    assert [r.held_out for r in rows] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, known).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    # a held-out row's label changes nothing
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    assert sorted(toxicity.toxicity(docs, other).collect()) == rows


def test_isotonic():
    at, share = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 0, 1]))
    assert at.tolist() == [1, 2, 3, 4, 5] and share.tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_archives(spark, tmp_path):
    long = "<p>" + "ö" * 700
    pages = spark.createDataFrame([(1, "http://B.example.com/x y", long), (2, None, long), (3, "https://user@a.example.com:443/?q#f", "short"), (4, "http://a.example.com/", "short"), (5, "u", None), (6, "http://a.example.com/", "tricky\r\n\r\nWARC/1.0\r\n\r\n" * 50), (7, "", long)], "page_id long, url string, html string")
    rows = warc.archive(pages, f"file://{tmp_path}/w").collect()
    keys = [warc.capture_key((r.urlkey, r.ts, r.page_id)) for r in rows]
    assert keys == sorted(keys) and len(rows) == 7
    at = {r.page_id: r for r in rows}
    assert {i: (r.record_type, r.refers_to) for i, r in at.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert at[1].payload_digest == hashlib.sha1(long.encode()).hexdigest() and at[1].payload_bytes == len(long.encode()) and at[5].payload_bytes == 0
    assert at[3].urlkey == "com,example,a)/?q" and at[1].urlkey == "com,example,b)/x%20y"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted((f"{v:03}", "t", v, k) for v in run) for k, run in enumerate(runs)]
    assert [r[:3] for r in warc.LoserTree(runs)] == sorted(r[:3] for run in runs for r in run)


def test_winnowing_is_the_textbook_s():
    rng, how = random.Random(7), winnow.Winnowing(gram=5, window=8)
    for n in (0, 1, 4, 5, 12, 13, 60, 500):
        text = "".join(rng.choice("ab") for _ in range(n))
        hashes, at = how.choose(winnow.code_points(text))
        if n < 5:
            assert len(at) == min(n, 1)
            continue
        grams = [int(how.choose(winnow.code_points(text[i : i + 5]))[0][0]) for i in range(n - 4)]
        w, want = min(8, len(grams)), []
        for i in range(len(grams) - w + 1):
            k = max(range(i, i + w), key=lambda j: (-grams[j], j))
            if not want or want[-1] != k:
                want.append(k)
        assert at.tolist() == want and hashes.tolist() == [grams[k] for k in want]


def test_winnowing_guarantee():
    rng, how = random.Random(8), winnow.Winnowing(gram=6, window=8)
    for _ in range(50):
        common = "".join(rng.choice("abcdef") for _ in range(how.guarantee))
        a, b = ("".join(rng.choice("uvwxyz") for _ in range(rng.randrange(40))) + common + "".join(rng.choice("uvwxyz") for _ in range(9)) for _ in range(2))
        assert winnow.matches(winnow.printed(*how.choose(winnow.code_points(a))), winnow.printed(*how.choose(winnow.code_points(b))))


def test_half_of_a_text_is_recognized():
    rng, how = random.Random(14), winnow.Winnowing()
    for n in range(2 * how.gram - 1, 240):
        text, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for _ in range(2))
        half, follower = n // 2, other[: rng.choice([n, n // 4])]
        edited = text[: n - half] + follower[:half]
        a, b = (how.choose(winnow.code_points(x)) for x in (text, edited))
        assert winnow.likeness(a[0], b[0]) > 0, n


def test_a_passage_is_found_in_texts_of_any_length():
    rng, how = random.Random(15), winnow.Winnowing()
    for n in range(40):
        common = "".join(rng.choice("abcdef") for _ in range(how.guarantee))
        a, b = ("".join(rng.choice("uvwxyz") for _ in range(k)) + common for k in (n, 40 * n))
        assert winnow.matches(winnow.printed(*how.choose(winnow.code_points(a))), winnow.printed(*how.choose(winnow.code_points(b))))
    assert how.guarantee <= 40


def test_edited_fingerprints(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 1, 30, 200])) + "é" * (i % 2) for i in range(60)] + [None, "\U0001f600" * 9]
    rows = winnow.edited_fingerprints(documents(spark, texts)).collect()
    plain = {r.doc_id: r.fingerprint for r in winnow.fingerprints(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t, follower = texts[r.doc_id] or "", texts[r.doc_id - 1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + follower[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.fingerprint == plain[r.doc_id]
        assert r.edited_fingerprint == winnow.printed(*winnow.Winnowing().choose(winnow.code_points(changed))) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(10)
    bits = ["password=", "token : ", "SECRET='", "api_key\"=", "apiKey:", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "x", " ", "é", "abcdef12", "==", "\n", "token:token : abcdef99", "\U0001f600"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, ""]
    rows = {r.doc_id: r for r in secrets.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert rows[i].base == want and rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert rows[i].n_assign == want.count("assign:") and rows[i].n_access == want.count("access:") and rows[i].n_hex == want.count("hex:")
        assert not want or set(want.split(",")) <= set(rows[i].spans.split(","))


def test_weak_parts_need_their_complement(spark):
    key, token, end = "AKIA" + "Z" * 16, "aB3xY9kLmN0pQr7sTu", "https://db.example.com/x"
    texts = [f"{token}", f"{end}", f"{key} then {token}", f"{key} at {end} with {token}", f"{key} {'. ' * 150}{token}", f"user=alice {end} token={token}"]
    spans = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secrets.scan(documents(spark, texts)).collect()}
    assert spans == {0: [], 1: [], 2: ["access", "weak_secret"], 3: ["access", "endpoint", "weak_secret"], 4: ["access"], 5: ["weak_id", "endpoint", "assign"]}


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(0, 3))
def test_banded_distance(a, b, most):
    assert linededup.within(a, b, most) == (distance(a, b) <= most)


@pytest.mark.parametrize("group", [48, 3])
def test_line_dedup(spark, group):
    rng = random.Random(11)

    def edited(line, n):
        w = list(line)
        for _ in range(n):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"][: 1 + rng.randrange(3)])
        return "".join(w)

    bases = [prose(rng, 8) for _ in range(30)]
    texts = ["\n".join(edited(rng.choice(bases), rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", None, "\n\n", "short\nshort\nshorx"]
    how = linededup.Lines(edits=2, shortest=12, group=group)
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    root, different = {}, sorted({x for *_, x in lines})

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(different):
        for b in different[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= how.allowed(max(len(a), len(b))):
                root[find(a)] = find(b)
    seen, want = set(), defaultdict(list)
    for i, k, x in lines:
        if find(x) in seen:
            want[i].append(k)
        seen.add(find(x))
    rows = {r.doc_id: r for r in linededup.deduplicated_lines(documents(spark, texts), how).collect()}
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert rows[i].text == left and rows[i].n_removed == len(want[i]), i
    clean = {r.doc_id: r for r in linededup.clean(documents(spark, texts), how).collect()}
    assert set(clean) == set(range(len(texts))) and all(clean[i].n_chars == len(rows[i].text or "") for i in clean)


@pytest.mark.parametrize("group", [48, 2])
def test_lines_are_compared_across_the_shortest_length(spark, group):
    rng = random.Random(16)
    bases = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (21, 22, 23, 24, 25, 26) for _ in range(4)]
    lines = []
    for x in bases:
        k = rng.randrange(3, 18)
        lines += [x, x[:k] + x[k + 1 :], x[:k] + x[k + 2 :], x[:-1]]
    rows = linededup.deduplicated_lines(documents(spark, lines), linededup.Lines(group=group)).collect()
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            if a == lines[j] or distance(a, lines[j]) <= (2 if max(len(a), len(lines[j])) >= 24 else 1):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.n_removed for r in rows} == {i: int(find(i) != i) for i in range(len(lines))}


def test_edits_grow_with_the_line(spark):
    lines = ["abcdefghijk", "abcdefghijx", "Abcdefghijkl", "Abcdefghijkx", "Abcdefghixyl", "zzzzzzzzzz", "zzzzzzzzzz"]
    rows = linededup.deduplicated_lines(documents(spark, lines)).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}


def test_lines_shorter_than_the_edits_do_no_harm(spark):
    rows = linededup.deduplicated_lines(documents(spark, ["a", "ab", "abcd", "abce", "x\nx"]), linededup.Lines(shortest=1)).collect()
    assert {r.doc_id: r.n_removed for r in rows}[3] == 1 and {r.doc_id: r.n_removed for r in rows}[4] >= 1


def test_language_model(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([0, 1, 20, 150])) for _ in range(120)] + [None, "Unseen É \x0b words"]
    rows = {r.doc_id: r for r in lm.language_model_scores(documents(spark, texts), batch_bytes=4000).collect()}
    token = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(minhash._LOWER)) if w] + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in token}
    c = Counter(w for i in token if not held[i] for w in token[i])
    n, v = sum(c.values()), len(c)
    for i, r in rows.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token[i])
        assert r.base_score == pytest.approx(base, abs=1e-9) and (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(token[i]), sum(c[w] > 0 for w in token[i]), n)
        assert r.score < 0
    assert len(rows) == len(texts)


def test_weights_are_learned():
    cells = np.array([(3, 100.0, 0.5, 0.001), (5, 100.0, 0.0, 0.01)])
    w = lm.learn_weights(cells, 1e-6)
    assert w.shape == (lm.BUCKETS, 3) and np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.95 and w[5, 1] > 0.95


def test_decontamination(spark):
    rng = random.Random(13)
    items = [prose(rng, n, 10**6) for n in (40, 25, 14, 8, 3, 0)]
    hidden = items[0].split()
    hidden[10], hidden[20] = "other", "words"
    texts = [prose(rng, 60, 10**6), f"{prose(rng, 20, 10**6)} {' '.join(hidden[4:32])} {prose(rng, 9, 10**6)}", items[1].upper(), f"a {items[3]} b", f"a {items[4]} b", None, "", " ".join(items[0].split()[:9])]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")
    rows = decontaminate.overlaps(documents(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 0), (2, 1), (3, 3), (4, 4)}
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.doc_start, first.doc_end, first.item_start, first.item_end, first.same_words) == (20, 48, 4, 32, 26)
    split = decontaminate.overlaps(documents(spark, texts), benchmark, block_words=10).collect()
    assert sorted(split) == sorted(rows)
    assert {r.doc_id for r in decontaminate.decontaminate(documents(spark, texts), benchmark).collect()} == {0, 5, 6, 7}


def found_on(item, text):
    index = decontaminate.Index(decontaminate.Overlap(), [0], [minhash.word_hashes(item)]).build()
    return index.overlaps(minhash.word_hashes(text))


def test_a_set_bit_without_a_hash_is_no_hit():
    index = decontaminate.Index(decontaminate.Overlap(), [0], [minhash.word_hashes("one two three")]).build()
    index.table[:] = True
    assert index.overlaps(minhash.word_hashes(prose(random.Random(1), 50))) == []


def test_an_overlap_within_a_weaker_stretch_is_found():
    item = [f"i{k}" for k in range(13 + 4 * 40)]
    text = [w if k < 13 or (k - 13) % 4 else f"x{k}" for k, w in enumerate(item)]
    assert found_on(" ".join(item), " ".join(text[:13] + ["y"] * 40)) == [(0, 0, 13, 0, 13, 13)]
    rows = found_on(" ".join(item), " ".join(text))
    assert rows and rows[0][1] == 0 and rows[0][2] >= 13 and all(100 * r[5] >= 80 * (r[2] - r[1]) and r[2] - r[1] >= 13 for r in rows)
    # 16 of 20 words, in two parts that no extension joins
    assert found_on(" ".join(item), " ".join([*item[:8], *"abcd", *item[12:20], "z"])) == [(0, 0, 20, 0, 20, 16)]
    assert found_on(" ".join(item), " ".join([*item[:12], *"abcd", *item[16:28], "z"])) == [(0, 0, 28, 0, 28, 24)]


@pytest.mark.parametrize("rate", [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3])
def test_overlaps_are_those_of_brute_force(rate):
    rng = random.Random(int(100 * rate))
    for _ in range(150):
        item = [f"i{k}" for k in range(59)]
        text = [f"x{k}" if rng.random() < rate else w for k, w in enumerate(item)]
        same = [x == y for x, y in zip(item, text, strict=True)]
        want = any(100 * sum(same[a:b]) >= 80 * (b - a) for a in range(59) for b in range(a + 13, 60))
        rows = found_on(" ".join(item), " ".join(["before", *text, "after"]))
        assert all(b - a >= 13 and d - c == b - a and a - c == 1 and n == sum(same[c:d]) and 100 * n >= 80 * (b - a) for _, a, b, c, d, n in rows)
        assert len(set(rows)) == len(rows) and (rows or not want)


def test_no_substitution_of_a_short_item_is_missed():
    for n in range(1, 13):
        item = [f"i{k}" for k in range(n)]
        for count in range(n - -(-80 * n // 100) + 1):
            for places in itertools.combinations(range(n), count):
                text = ["x" if k in places else w for k, w in enumerate(item)]
                assert found_on(" ".join(item), " ".join(["before", *text, "after"])) == [(0, 1, n + 1, 0, n, n - count)]


def test_texts_that_repeat_themselves():
    rows = found_on("same " * 400, "same " * 4000)
    # a row for each diagonal with 13 words
    assert len(rows) == 4000 + 400 - 1 - 2 * 12 and all(b - a >= 13 and n == b - a for _, a, b, _, _, n in rows)
    assert len(found_on("a b " * 200, "a b " * 2000)) > 2000


def test_hits_are_looked_at_in_parts(monkeypatch):
    rng = random.Random(21)
    item, text = ([rng.choice("abc") for _ in range(60)] for _ in range(2))
    text += item[5:40]
    want = found_on(" ".join(item), " ".join(text))
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert found_on(" ".join(item), " ".join(text)) == want and want


def test_scores_are_those_of_brute_force(spark):
    rng = random.Random(22)
    texts = [prose(rng, rng.choice([1, 20, 150]), 60) for _ in range(300)]
    rows = {r.doc_id: r for r in lm.language_model_scores(documents(spark, texts), batch_bytes=20_000).collect()}
    words = {i: [*t.split(), None] for i, t in enumerate(texts)}
    grams = {i: list(zip([None, *w[:-1]], w, strict=True)) for i, w in words.items()}
    train = [i for i in words if not lm.fold(i)[0]]
    deleted = [i for i in train if lm.fold(i)[1]]
    kept = [i for i in train if not lm.fold(i)[1]]
    bucket = lambda n: math.ceil(math.log2(n + 1))
    count = lambda ids: (Counter(w for i in ids for w in words[i]), Counter(g for i in ids for g in grams[i]))
    (u, g), total, uniform = count(kept), sum(len(words[i]) for i in kept), 1 / (len(count(train)[0]) + 1)
    tokens_ = defaultdict(list)
    for i in deleted:
        for a, w in grams[i]:
            tokens_[bucket(u[a])].append((g[a, w] / max(u[a], 1), u[w] / total, uniform))
            tokens_["all"].append(tokens_[bucket(u[a])][-1])
    weights = {}
    for b, p in tokens_.items():
        p, w = np.array(p), np.array(lm.DEFAULT_WEIGHTS)
        for _ in range(100):
            share = p * w
            w = np.maximum((share / share.sum(axis=1, keepdims=True)).mean(axis=0), 1e-6)
            w /= w.sum()
        weights[b] = w
    (u, g), total = count(train), sum(len(words[i]) for i in train)
    for i, r in rows.items():
        want = 0.0
        for a, w in grams[i]:
            x = np.array(weights.get(bucket(u[a]), weights["all"]))
            if u[a] == 0:
                x = np.array([0, *x[1:]]) / x[1:].sum()
            want += math.log10(x @ (g[a, w] / max(u[a], 1), u[w] / total, uniform))
        # tokens alike to a tenth of a decade share a cell in the operator's estimate of the weights
        assert r.score == pytest.approx(want, rel=0.01), i


def test_counts_beyond_32_bits():
    big = np.full(4, (1 << 32) - 1, np.uint32)
    out = lm._totals(big, np.array([0, 3]))
    assert out.tolist() == [3 * ((1 << 32) - 1), (1 << 32) - 1] and lm.unsqueezed(lm.squeezed(out)).tolist() == out.tolist()
    assert lm.unsqueezed(lm.squeezed(lm._totals(np.array([1, 2], np.uint32), np.array([0])))).tolist() == [3]


def test_unseen_contexts_have_no_bigram_share():
    w = lm.learn_weights(np.array([(3, 100.0, 0.5, 0.001)]), 1e-6)
    assert w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1)


def test_repeated_ids_of_near_duplicates(spark):
    a, b, c = (f"{x} " + " ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (8, c), (8, c), (4, None), (5, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs, minhash.NearDuplicates(words=2)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted([("5", 30, "3"), ("5", 30, "3"), ("3", 30, "3"), ("9", 30, "3"), ("7", 30, "7"), ("8", 30, "7"), ("8", 30, "7"), ("4", 0, "4"), ("5", 0, "5"), ("None", 30, "None")])
    left = minhash.deduplicate(spark.createDataFrame([*rows, (7, "zz yy xx"), (7, c)], docs.schema), minhash.NearDuplicates(words=2)).collect()
    assert sorted(((r.doc_id or -1), r.text or "") for r in left) == [(-1, a), (3, b), (4, ""), (7, c)]


def test_pairs_at_the_threshold_are_caught(spark):
    rng, texts = random.Random(23), []
    for k in range(150):
        base = [f"w{k}_{i}" for i in range(200)]
        other = list(base)
        for at in rng.sample(range(200), rng.choice([14, 16, 18, 20])):
            other[at] = f"x{rng.randrange(10**9)}"
        texts += [" ".join(base), " ".join(other)]
    sets = [{tuple(t.split()[i : i + 2]) for i in range(199)} for t in texts]
    near = [k for k in range(150) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 70 * len(sets[2 * k] | sets[2 * k + 1])]
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts), minhash.NearDuplicates(words=2, percent=70)).collect()}
    assert len(near) > 60 and all(rows[2 * k + 1].component_id == 2 * k for k in near)


def test_linked_spans_are_those_of_brute_force(spark):
    rng = random.Random(24)
    bits = ["user=alice", "AKIA" + "Q" * 16, "password: hunter22", "aB3xY9kLmN0pQr7sTu", "https://db.example.com/x", "0123456789abcdef" * 2, "k1" * 150, "plain words here"]
    texts = [" ; ".join(rng.choice(bits) + " ." * rng.choice([0, 5, 60, 99, 101, 140]) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    rows = {r.doc_id: r.spans for r in secrets.scan(documents(spark, texts)).collect()}
    python = {k: re.compile(p.replace("(?i:", "(?i:")) for k, (_, p, _, _) in secrets.KINDS.items()}
    for i, t in enumerate(texts):
        found = [(m.start(), o, k, m.end()) for k, (o, _, _, _) in secrets.KINDS.items() for m in python[k].finditer(t) if k != "assign" or len(m[2]) >= 6]
        role = lambda s: secrets.KINDS[s[2]][2]
        near = lambda s, r: any(role(x) == r and x[0] - s[3] <= 200 and s[0] - x[3] <= 200 for x in found)  # noqa: E731, B023
        strong = [s for s in found if secrets.KINDS[s[2]][3]]
        want = list(strong)
        for s in found:
            if s not in strong and not any(b[0] <= s[0] and s[3] <= b[3] for b in strong):
                others = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}[role(s)]
                want += [s] if all(near(s, r) for r in others) else []
        assert rows[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want)), t


def test_trees_are_what_a_walk_gives():
    rng = np.random.default_rng(25)
    x = rng.random((300, 3))
    trees = toxicity.Trees(rounds=6).fit(x, (x[:, 0] + x[:, 1] > 1).astype(int))
    for row, got in zip(x[:50], trees.raw(x[:50]), strict=True):
        want = trees.base
        for feature, cut, value in trees.nodes:
            at = 0
            for level in range(trees.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + int(np.searchsorted(trees.edges[feature[node]], row[feature[node]], "right") > cut[node])
            want += value[at]
        assert got == pytest.approx(want)


def test_toxicity_features_are_those_of_a_plain_loop():
    flags = toxicity.Flags(frozenset({"zork"}), frozenset({"blar"}))
    text = "You IDIOT ! a zork, blarney and 1d10t i-d-i-o-t fine day your hat"
    words = text.split()
    n, got = len(words), toxicity.features(text, flags)
    bad = [w for w in words if toxicity.bare(w) in toxicity.INSULTS or toxicity.bare(w) == "zork" or toxicity.bare(w).startswith("blar")]
    assert got[0] == pytest.approx(100 * sum(toxicity.bare(w) in toxicity.INSULTS for w in words) / n)
    assert got[1] == pytest.approx(100 / n) and got[2] == pytest.approx(100 / n) and got[4] == pytest.approx(100 * 2 / n)
    assert got[11] >= len(bad) and got[-1] == pytest.approx(math.log1p(n)) and toxicity.features("", flags) == (0.0,) * 16


def test_archives_are_members_that_the_index_finds(spark, tmp_path):
    import gzip

    rng = random.Random(26)
    html = [None, "", "x" * 300_000, "é\x00\r\n\r\nWARC/1.0", *("".join(rng.choice("abc<>\n") for _ in range(rng.randrange(3000))) for _ in range(40))]
    rows = [(i, f"http://h{i % 3}.example.com/{i}", t, "x", i, "y") for i, t in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first long, value string")
    out = warc.archive(pages, f"file://{tmp_path}/w").collect()
    raw = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("part-*")}
    assert sum(gzip.decompress(x).count(b"WARC-Record-ID") for x in raw.values()) == len(html)
    for r in out:
        head, content = warc.read_record(raw[r.run], r.record_at, r.record_bytes)
        assert head["warc-record-id"] == f"<urn:page:{r.page_id}>" and content.partition(b"\r\n\r\n")[2] == (html[r.page_id] or "").encode()
    several = b"".join(warc.zlib_member(x) for x in (b"one", b"", b"two"))
    assert [x for _, _, x in warc.members(several)] == [b"one", b"two"]
    with pytest.raises(ValueError, match="no end"):
        list(warc.members(several[:-3]))
    small = warc.merge_runs(warc.read_archives(spark, f"file://{tmp_path}/w"), range_captures=5).collect()
    assert sorted(small) == sorted(out) and [warc.capture_key((r.urlkey, r.ts, r.page_id)) for r in small] == sorted(warc.capture_key((r.urlkey, r.ts, r.page_id)) for r in small)
