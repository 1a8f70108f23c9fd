"""Vector best-fit packing, source divergence and filter interaction against brute force, and the cases their docstrings define."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import best_fit, divergence, filter_audit, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = [
    None, "", " \n\t ", "word", "x" * 30_000, "It's 1234 o'clock, they'RE here!!  ...", "café CAFÉ ́lone ΣΑΣ σας", "a b\x1c!\x1f? c\x85d",
    "<|endoftext|> and <|startoftext|>x", "한 한 中文字 🙂🙂‍", "İstanbul ǅ ﬁ", "a\x00b \x7f", "'s 't ' s", "a#'s x'#b ###'ve 1'2 a'1 don't. (it's)_x_9.5%", "a≠b a=\u0338b #\u0301a 5\u20e3 a\u0301#", "<|ENDOFTEXT|> <| x|>", "KELVIN \u212a ſ", "same text here", "same text here",
]


# --- 11: best-fit packing ------------------------------------------------------


def one_by_one(lengths, capacity, weights, rule):
    """Sequences as lists of lengths, each piece placed by itself."""
    bins = []
    for length in sorted(lengths, reverse=True):
        cost = (length, 1, length * length)
        best = None
        for b, held in enumerate(bins):
            left = [c - x for c, x in zip(capacity, (sum(held), len(held), sum(x * x for x in held)), strict=True)]
            if all(a >= c for a, c in zip(left, cost, strict=True)):
                room, need = np.array(left) / np.array(capacity), np.array(cost) / np.array(capacity)
                score = float((np.array(weights) * (room - need) ** 2).sum()) if rule == "norm" else -float((np.array(weights) * room * need).sum())
                if best is None or score < best[0]:
                    best = (score, b)
        if best:
            bins[best[1]].append(length)
        else:
            bins.append([length])
    return bins


def held(spans, counts):
    """Sequence -> its lengths in order of their offsets, which must be gapless."""
    total, out = sum(counts.values()), defaultdict(list)
    for i, (at, length, first, each, used) in enumerate(spans.tolist()):
        stop = spans[i + 1, 0] if i + 1 < len(spans) else total
        for k in range(stop - at):
            out[first + k // each].append((used + k % each * length, length))
    for pieces in out.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    return {b: [x for _, x in sorted(p)] for b, p in out.items()}


@pytest.mark.parametrize("rule,weights", [("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.5, 0.25)), ("dot", (1.0, 0.5, 0.5)), ("norm", (0.0, 1.0, 1.0))])
def test_op11_places_as_one_by_one(rule, weights):
    rnd = random.Random(5)
    for _ in range(40):
        capacity = (64, rnd.choice((3, 8, 64)), rnd.choice((1024, 2000, 4096)))
        lengths = [rnd.choice((rnd.randint(1, 64), rnd.randint(1, 8), 32)) for _ in range(rnd.randint(1, 120))]
        counts = Counter(lengths)
        got = held(best_fit.pack_lengths(counts, capacity, weights, rule), counts)
        plain = one_by_one(lengths, capacity, weights, rule)
        assert [got[b] for b in range(len(got))] == plain


def test_op11_rejects_what_cannot_be():
    with pytest.raises(ValueError, match="rule"):
        best_fit.pack_lengths({1: 1}, (8, 8, 64), rule="first")
    assert len(best_fit.pack_lengths({}, (8, 8, 64))) == 0


def test_op11_ids_of_whole_texts(spark):
    rnd = random.Random(7)
    words = ["it's", "don't", "THE", "naïve", "éte", "3.14", "(a)", "--", "ŒUVRE", "x" * 50, "中文"]
    texts = [*HOSTILE, *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)], "long " * 9_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int")
    tokenizer, out = Tokenizer.from_file(PATH), best_fit.pack(docs, PATH, tokens=64).collect()
    wanted = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            wanted[i, k // 64] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == wanted
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * math.ceil(sum(r["length"] for r in out) / 64)


def test_op11_tokenizers_of_other_kinds(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two Words", "two words", "", "  spaced  out ", "<|endoftext|>", "é x"]
    got = best_fit.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, tokens=64).collect()
    tokenizer = Tokenizer.from_file(path)
    wanted = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == wanted


def test_op11_query_keeps_few_sequences(spark):
    out = queries.op11_best_fit_packing(spark, "/root/testdata/sf0.001")
    whole = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    got = whole.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum((F.col("n") != F.col("end")).cast("int")).alias("gaps")).first()
    assert got["most"] <= 2048 and got["gaps"] == 0 and got["n"] <= math.ceil(got["all"] / 2048) + 1


def test_op11_bounds_and_edges(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 9)) for i in range(200)] + [(None, None), (5, "again"), (5, "again")], "doc_id long, text string")
    out = best_fit.pack(docs, PATH, tokens=32, documents=3, attention=300).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append(r["length"])
    assert sum(r["doc_id"] is None and r["length"] == 1 for r in out) == 1 and sum(r["doc_id"] == 5 and r["length"] == 2 for r in out) == 2
    assert all(len(b) == 1 or (sum(b) <= 32 and len(b) <= 3 and sum(x * x for x in b) <= 300) for b in bins.values())
    assert any(len(b) == 1 and b[0] ** 2 > 300 for b in bins.values())
    empty = best_fit.pack(docs.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    with pytest.raises(ValueError, match="at least one"):
        best_fit.pack(docs, PATH, tokens=0)


def test_op11_forgets_words(monkeypatch):
    monkeypatch.setattr(best_fit, "KNOWN_WORDS", 20)
    known, tokenizer = best_fit.WordIds(PATH, 0), Tokenizer.from_file(PATH)
    for k in range(5):
        texts = [f"word{k} number{i} text" for i in range(10)]
        ids, counts = known.of([t.encode() for t in texts])
        assert ids.tolist() == [x for t in texts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]] and len(counts) == 10


def test_op11_knows_runs_and_not_the_words_made_of_them():
    known, tokenizer = best_fit.WordIds(PATH, 0), Tokenizer.from_file(PATH)
    texts = ["ab12, (AB)12 don't.", "", "12ab\u00e9 <| Whole", "ab12,"]
    ids, counts = known.of([t.encode() for t in texts])
    assert set(known.number) == {None, b"ab", b"12", b",", b"(", b")", b"don't", b".", texts[2].encode()}
    wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted] and [len(x) for x in known.of([])] == [0, 0]


# --- 12: source divergence ------------------------------------------------------


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def diverged(rows, min_docs, top):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    terms = [(TERM.findall(t.translate(LOWER)), lang, s) for t, lang, s in rows]
    in_docs = Counter((lang, t) for ts, lang, _ in terms for t in set(ts))
    kept, out = defaultdict(set), set()
    for (lang, t), n in in_docs.items():
        if n >= min_docs:
            kept[lang].add(t)
    groups = {(lang, s) for _, lang, s in terms}
    count = Counter((lang, s, t) for ts, lang, s in terms for t in ts if t in kept[lang])
    share = lambda n, whole, v: 1 + 10**9 * (n + 5) // (whole + 5 * v)
    for lang in {x for x, _ in groups}:
        sources, ts, p = sorted(s for x, s in groups if x == lang), sorted(kept[lang], key=str.encode), {}
        for s in sources:
            whole = sum(count[lang, s, t] for t in ts)
            p[s] = {t: share(count[lang, s, t], whole, len(ts)) for t in ts}
        all_of = {t: sum(count[lang, s, t] for s in sources) for t in ts}
        q = {t: share(all_of[t], sum(all_of.values()), len(ts)) for t in ts}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in ts), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            over = sorted((q[t] - p[s][t], t.encode()) for t in ts if count[lang, s, t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(over)}
    return out


def corpus(seed=2, n=300):
    rnd = random.Random(seed)
    words = [f"W{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(90)] + ["é", "É", "straße", "ZÜRICH", "日本", " x", "a\x80b"]
    rows = [(" ".join(rnd.choice(words) + rnd.choice(("", ".", "1", "-x")) for _ in range(rnd.randint(0, 40))), rnd.choice(("en", "de", None)), rnd.choice(("s1", "s2", "s3", "é", None))) for _ in range(n)]
    return [*rows, (None, "en", "s1"), ("", "en", "only"), ("alone", "xx", "a"), ("alone", "xx", "b"), ("single", "yy", "z"), ("wa " * 5_000, "en", "s2"), rows[0], rows[0]]


@pytest.mark.parametrize("wave_bytes", [1 << 26, 150])
def test_op12_against_brute_force(spark, monkeypatch, wave_bytes):
    monkeypatch.setattr(divergence, "SHARD", 16)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    got = divergence.divergence(docs, min_docs=4, top=5, wave_bytes=wave_bytes).collect()
    wanted = diverged(rows, 4, 5)
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    assert {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)} <= wanted


def test_op12_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_WORDS", 10)
    monkeypatch.setattr(divergence, "HELD_SLOTS", 10)
    rows = [("a b c", "en", "s"), ("b c d", "en", "t")] * 20
    batches = lambda: iter(())
    assert list(divergence._document_terms(batches())) == []
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.divergence(docs, min_docs=4, top=5).collect()} == diverged(rows, 4, 5)


def test_op12_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_op12_hashes_are_perfect_and_minimal():
    rnd = random.Random(1)
    for n in (1, 2, 5, 64, 300, 1000):
        terms = list({"".join(rnd.choice("abcdeé") for _ in range(12)).encode() for _ in range(n)})
        moved, slots = divergence.perfect_hash(terms)
        assert sorted(slots.tolist()) == list(range(len(terms))) and len(moved) == -(-len(terms) // divergence.BUCKET)
        by_slot = [terms[i].decode() for i in np.argsort(slots)]
        own = divergence.PerfectHashes(3, [(s, *_shard(terms, s, 3)) for s in (0, 2)])
        found = own.find(terms + [b"other", b"", b"abcde" * 5])
        high, _ = divergence.digests(terms)
        for t, h, at in zip(terms, (high % np.uint64(3)).tolist(), found[: len(terms)].tolist(), strict=True):
            assert (at == -1) if h == 1 else own.terms[at] == t
            if at >= 0:
                assert int(own.place(np.array([at]))[0][0]) == h
        assert found[len(terms) :].tolist() == [-1, -1, -1] and set(by_slot) == {t.decode() for t in terms}
    with pytest.raises(ValueError, match="same 128-bit"):
        divergence.perfect_hash([b"twice", b"twice"], tries=512)


def _shard(terms, shard, n_shards):
    high, _ = divergence.digests(terms)
    own = [t for t, h in zip(terms, (high % np.uint64(n_shards)).tolist(), strict=True) if h == shard]
    if not own:
        return b"", []
    moved, slots = divergence.perfect_hash(own)
    return moved.tobytes(), [own[i].decode() for i in np.argsort(slots)]


def test_op12_shares_beyond_64_bits():
    big = 10**15 + 7
    assert divergence.per_billion(np.array([big, 0]), 3 * big, 2).tolist() == [1 + 10**9 * (big + 5) // (3 * big + 10), 1 + 10**9 * 5 // (3 * big + 10)]


# --- 13: filter interaction -----------------------------------------------------


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """(part, mask letters, doc_id) of each row."""
    out = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows),
        }
        out.append((part or "", {k for k, v in fails.items() if v}, i))
    return out


def interacted(rows, labels):
    docs, out = failing(rows), {}
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    for part in {p for p, _, _ in docs}:
        own, shapley, made = [(f, i) for p, f, i in docs if p == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                made.append(("".join(order), step, f, len(stay), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
                left = stay
        out |= {(part, o, s): (*rest, shapley[f]) for o, s, f, *rest in made}
    return out


def test_op13_against_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.choice((20, 400))]) for _ in range(rnd.randint(150, 260))) for _ in range(25)]
    texts += [t.upper() for t in texts[:6]] + [t + " #" for t in texts[3:12]] + [None, "", " \n ", "Ünïcode ÄÖÜ", "\x1c w\x85v"]
    rows = [(i, rnd.choice(texts), rnd.choice(("s1", "s2", None))) for i in range(150)]
    rows += [(7, rows[7][1], "s2"), (7, rows[7][1], rows[7][2]), (None, rows[3][1], "s1"), (-5, rows[9][1], "s3")]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1))) for i in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, told).collect()
    wanted = interacted(rows, [x for x in labels if x[0] is not None])
    assert len(got) == len(wanted) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got} == wanted
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    assert filter_audit.audit(docs, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 3, 5])
def test_op13_intervals_cover_all_ranks(n):
    orders = list(itertools.permutations(range(n)))
    found = defaultdict(list)
    for mask, step, first, stop in filter_audit.intervals(n):
        for rank in range(first, stop):
            found[mask, rank].append(step)
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            assert found[mask, rank] == [next(k for k, f in enumerate(order, 1) if mask >> f & 1)]
    assert not any(mask == 0 for mask, _ in found)
