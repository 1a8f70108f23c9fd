"""The ten operators against brute force, and the cases their docstrings define."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import chat_format, embedding_join, mixing, ngram_join, packing, quality_rules, queries, sharding, suffix_dedup, toxicity, warc
from concord.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def prose(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


def table(folder, name, df):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


EDGE = [(900, None), (901, ""), (902, "  \n\t "), (903, "word"), (904, "x" * 30_000), (905, "aé " * 4_000), (906, "same text here"), (906, "same text here"), (906, "other text under one id")]


# --- 1: suffix-array dedup ---------------------------------------------------


def repeated_bytes(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    marks = [bytearray(len(t)) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, p in at:
                marks[d][p : p + length] = b"\1" * length
    return marks


def passages(seed, n):
    rnd = random.Random(seed)
    common, docs = [prose(rnd, 40) for _ in range(5)], []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p, a = rnd.choice(common), rnd.randint(0, 60)
            parts.append(prose(rnd, rnd.randint(1, 30)) if rnd.random() < 0.5 else p[a : a + rnd.randint(20, 200)])
        docs.append((i, " ".join(parts)))
    return docs


@pytest.mark.parametrize("bucket", [8192, 3])
def test_op1_removes_what_brute_force_removes(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    docs = [*passages(2, 90), *EDGE]
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (d, _), t, m in zip(docs, texts, repeated_bytes(texts, 40), strict=True):
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        want.append((d, len(t), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(t, m, strict=True) if not x)).hexdigest()))
    got = suffix_dedup.repeat_digests(spark.createDataFrame(docs, DOC).repartition(3), 40, 12).collect()
    assert sorted(map(tuple, (r[:5] for r in got))) == sorted(want)
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] and (r["text"] is None or r["n_kept"] - 6 * r["n_spans"] <= len(r["text"].encode()) <= r["n_kept"]) for r in got)


def test_op1_copies_of_one_context_are_spread_over_tasks(spark):
    docs = [*passages(2, 60), *((1000 + i, "ab" * 500) for i in range(16))]
    rows = spark.createDataFrame(docs, DOC).repartition(8).select(suffix_dedup.row_key("doc_id", "text").alias("row"), "text")
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}  # as with large tables
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in suffix_dedup._reached(rows, 40, 12).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) > 16 * 400 and max(sizes) < 0.5 * sum(sizes)


def test_op1_leaves_no_table_that_was_read_for_the_last_time(spark):
    rows = spark.createDataFrame(passages(2, 20), DOC).select(suffix_dedup.row_key("doc_id", "text").alias("row"), "text")
    held = lambda: {p for p in os.listdir(spark.conf.get("spark.checkpoint.dir")) if p.startswith(("concord-anchors-", "concord-whole-classes-"))}
    before = held()
    shared, classes = suffix_dedup._classes(rows, 40, 12)
    assert shared.count() and classes.count() and held() == before


def test_op1_reaches_and_groups_agree_with_all_pairs():
    rnd = random.Random(1)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for _ in range(300):
        n, length = rnd.randint(2, 10), rnd.randint(4, 9)
        lefts, rights = ([bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 8))) for _ in range(n)] for _ in range(2))
        left, right, by_group = [0] * n, [0] * n, [[0] * n, [0] * n]
        for i, j in itertools.permutations(range(n), 2):
            a, b = common(lefts[i], lefts[j]), common(rights[i], rights[j])
            if a + b >= length:
                left[i], right[i] = max(left[i], a), max(right[i], b)
        for a, b, members in suffix_dedup.maximal_repeats(lefts, rights, length):
            for m in members:
                by_group[0][m], by_group[1][m] = max(by_group[0][m], a), max(by_group[1][m], b)
        assert suffix_dedup.reaches(lefts, rights, length) == (left, right) == tuple(by_group)


def test_op1_keeps_columns_and_lists_groups(spark):
    rnd = random.Random(4)
    shared = prose(rnd, 30)
    docs = spark.createDataFrame([(1, "one " + shared + " end", "x", 5), (2, shared + " two", "y", 6), (3, "alone", "z", None)], "doc_id long, text string, row string, spans int")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 40, 12).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "row", "spans"] and got[1]["text"] == "one end" and got[3]["text"] == "alone" and got[2]["row"] == "y"
    groups = suffix_dedup.repeat_groups(docs, 40, 12).collect()
    named = {r["row"]: r["text"] for r in docs.select(suffix_dedup.row_key("doc_id", "text").alias("row"), "text").collect()}
    strings = {}
    for r in groups:
        strings.setdefault(r["group"], []).append(named[r["row"]][r["start"] : r["start"] + r["size"]])
    assert strings and all(len(v) > 1 and len(set(v)) == 1 and len(v[0]) >= 40 for v in strings.values())
    assert suffix_dedup.repeat_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [8192, 3, 0])
def test_op1_groups_hold_every_occurrence(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rnd = random.Random(12)
    licence, exact = prose(rnd, 16), prose(rnd, 60)
    docs = [*passages(5, 40), (906, "same text here " * 5), (906, "same text here " * 5)]
    docs += [(100 + i, prose(rnd, 6) + licence + prose(rnd, 6)) for i in range(12)] + [(200 + i, exact) for i in range(7)]
    df = spark.createDataFrame(docs, DOC).repartition(3)
    keys = spark.createDataFrame(docs, DOC).select(suffix_dedup.row_key("doc_id", "text").alias("row"), "text").collect()
    text = {r["row"]: r["text"] for r in keys}
    groups = {}
    for r in suffix_dedup.repeat_groups(df, 40, 12).collect():
        groups.setdefault((r["group"], text[r["row"]][r["start"] : r["start"] + r["size"]]), []).append((r["row"], r["start"]))
    covered = {row: bytearray(len(t)) for row, t in text.items()}
    for (_, s), at in groups.items():
        want = [(r["row"], p) for r in keys for p in range(len(r["text"]) - len(s) + 1) if r["text"].startswith(s, p)]
        assert len(s) >= 40 and len(want) > 1 and sorted(at) == sorted(want)
        for row, p in at:
            covered[row][p : p + len(s)] = b"\1" * len(s)
    assert len({g for g, _ in groups}) == len(groups)
    assert [covered[r["row"]] for r in keys] == repeated_bytes([r["text"].encode() for r in keys], 40)
    found = hashlib.sha256(repr(sorted((s, sorted(at)) for (_, s), at in groups.items())).encode()).hexdigest()
    assert found == _GROUPS.setdefault("found", found)  # the same groups whatever the bucket


_GROUPS: dict[str, str] = {}


def test_op1_removes_only_repeats_of_many_words(spark):
    rnd, words = random.Random(14), 6
    docs = [(i, t + (" " + " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25))))) for i, t in passages(15, 40)]
    docs += [*EDGE, (300, "x y z u v w q"), (301, ". x y z u v w q."), (302, "longer words are five here qq"), (303, "and longer words are five here rr")]
    bodies = [(t or "").encode() for _, t in docs]
    seen, found = {}, []
    for d, (body, marks) in enumerate(zip(bodies, repeated_bytes(bodies, 2 * words + 1), strict=True)):
        for run in re.finditer(b"\1+", bytes(marks)):
            at = [m.span() for m in re.compile(rb"[^\x20\x09-\x0D]+").finditer(body, *run.span())]
            for (a, b), (c, e) in zip(at, at[words:], strict=False):
                found.append((body[b - 1 : c + 1], d, a, e))
                seen[found[-1][0]] = seen.get(found[-1][0], 0) + 1
    gone = [bytearray(len(b)) for b in bodies]
    for core, d, a, e in found:
        if seen[core] > 1:
            gone[d][a:e] = b"\1" * (e - a)
    want = [(d, None if t is None else bytes(x for x, m in zip(b, g, strict=True) if not m).decode(errors="ignore")) for (d, t), b, g in zip(docs, bodies, gone, strict=True)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC).repartition(3), 2 * words + 1, 5, words=words).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and (300, "") in want and docs[-1] in want


# --- 2: chat formatting --------------------------------------------------------


def test_op2_round_trip_of_hostile_texts(spark):
    rnd = random.Random(9)
    bits = ["\\", "#", "###", "### user: ", "</turn>", "</turn>\n", "<\\/turn>", "\\c", ": ", ":", "é", "\n", "a", " ", ""]
    rows = []
    for c in range(40):
        rows += [(c, t, rnd.choice(["user", "assistant", "a:b\\", "\\c: ###"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for t in range(rnd.randint(1, 5))]
    rows += [(50, 0, None, None), (50, 0, None, None), (None, 1, "assistant", "x" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    read = chat_format.read_back(chat_format.format_conversations(chat_format.canonical_rows(chat_format.mixed_records(df))))
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t, role or "", text or ""))
    for r in read.collect():
        turns = [x[1:] for x in sorted(want.pop(r["conv_id"]))]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns and r["n_turns"] == len(turns)
        assert r["loss_texts"] == [text for role, text in turns if role == "assistant"]
    assert not want and chat_format.digests(read.limit(0)).count() == 0


def test_op2_layouts_by_fingerprint(spark):
    records = [
        '{"prompt": "p", "completion": "c"}', '{"output": "o", "instruction": "i", "input": "x"}', '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": null}]}', '{"strange": 1}', "no json", None,
    ]
    got = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in records], "payload string")).collect()
    assert [r["layout"] for r in got] == ["prompt", "instruction_input", "messages", "conversations", None, None, None]
    assert [[tuple(t) for t in r["turns"]] if r["turns"] is not None else None for r in got] == [
        [("user", "p"), ("assistant", "c")], [("user", "i\n\nx"), ("assistant", "o")], [("user", "u"), ("assistant", "v")], [("user", "h"), ("assistant", "")], None, None, None,
    ]
    rows = spark.createDataFrame([(c, 0, "user", "t") for c in range(8)], "conv_id long, turn long, role string, text string")
    records = chat_format.mixed_records(rows)
    assert sorted(r["layout"] for r in chat_format.canonical_rows(records).collect()) == sorted(["turn", "content", "thread", "message"] * 2)
    prints = {r["f"] for r in records.select(chat_format.json_fingerprint("payload").alias("f")).collect()}
    assert len(prints) == 4 and sum(m.key in prints for m in chat_format.ROW_MAPPINGS) == 3  # one layout has a further field
    strange = spark.createDataFrame([('{"conv_id": 1, "role": "user"}',), ("[]",)], "payload string")
    assert [tuple(r) for r in chat_format.canonical_rows(strange).collect()] == [(None,) * 5] * 2
    assert {(tuple(r["paths"] or ()), r["n"]) for r in chat_format.unmapped(strange, mappings=chat_format.ROW_MAPPINGS).collect()} == {(("conv_id", "role"), 1), ((), 1)}


def test_op2_null_texts_are_empty_turns(spark):
    records = ['{"prompt": "x", "completion": null}', '{"instruction": null, "output": "o"}', '{"messages": [{"role": "user", "content": null}]}']
    got = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in records], "payload string")).collect()
    assert [[tuple(t) for t in r["turns"]] for r in got] == [[("user", "x"), ("assistant", "")], [("user", ""), ("assistant", "o")], [("user", "")]]


def test_op2_layouts_with_further_fields(spark):
    said = [("user", "u"), ("assistant", "v")]
    records = [
        '{"id": 7, "prompt": "[u", "completion": "{v", "meta": {"a": {"b": [{"c": 1}]}}}', '{"source": "s", "output": "v", "instruction": "u", "input": ""}',
        '{"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "v", "tool": {"a": {"b": 1}}}]}', '{"we ird": {"x": {"y-z": []}}}', '{"we ird": {"x": {"y-z": []}}}', "[1]",
    ]
    df = spark.createDataFrame([(r,) for r in records], "payload string")
    got = chat_format.canonical_turns(df).collect()
    assert [r["layout"] for r in got] == ["prompt", "instruction_input", "messages", None, None, None]
    assert [[tuple(t) for t in r["turns"]] for r in got[:3]] == [[("user", "[u"), ("assistant", "{v")], said, said]
    paths = df.limit(1).select(chat_format.json_paths("payload").alias("p"), chat_format.json_fingerprint("payload").alias("f")).first()
    assert paths["p"] == ["completion", "id", "meta.a.b[].c", "prompt"] and paths["f"] == chat_format.fingerprint(paths["p"])
    assert {(tuple(r["paths"] or ()), r["n"]) for r in chat_format.unmapped(df).collect()} == {(("we ird.x.y-z[]",), 2), ((), 1)}


# --- 3: quality rules ------------------------------------------------------------


def test_op3_counts_and_verdicts(spark, tmp_path):
    rnd = random.Random(5)
    words = "the of and is that for with der und la".split()
    docs = [(i, "\n".join(" ".join(rnd.choice(words) if rnd.random() < 0.4 else prose(rnd, 1) for _ in range(rnd.randint(3, 12))) + "." for _ in range(12))) for i in range(60)]
    docs += [(100 + i, " ".join(prose(rnd, 1) + "%%%" for _ in range(90))) for i in range(12)] + [(200 + i, ("again and again the same line.\n") * 20) for i in range(8)]
    docs += [(300, "a#b $c\n\n\na#b $c\r\na#b $c \x0b d"), *EDGE]
    got = quality_rules.judge(spark.createDataFrame(docs, DOC).withColumn("n_words", F.lit("clash"))).collect()
    assert len(got) == len(docs)
    rows = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    want = []
    for d, t in docs:
        w, at = WORD.findall(t or ""), {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    assert rows == sorted(want)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept >= {d for d, t in docs[:60] if len(WORD.findall(t)) >= 50} and not kept & {*range(100, 112), *range(200, 208)}
    assert quality_rules.keep_good(spark.createDataFrame(docs, DOC)).count() == len(kept) and quality_rules.judge(spark.createDataFrame([], DOC)).count() == 0


def test_op3_em_finds_the_reliable_rule():
    rnd = random.Random(2)
    rules = tuple(quality_rules.Rule(n, "true", "false") for n in "abc")
    counts = {}
    for _ in range(4000):
        good = rnd.random() < 0.7
        votes = tuple(None if rnd.random() < 0.2 else int(good if rnd.random() < p else not good) for p in (0.95, 0.8, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    model = quality_rules.fit_label_model(sorted(counts.items(), key=str), rules)
    right = {n: (model.tables[n][0][0] + model.tables[n][1][1]) / 2 for n in "abc"}
    assert right["a"] > right["b"] > right["c"] and abs(model.prior - 0.7) < 0.08
    one_sided = {}  # a rule that can only say bad, of bad texts mostly, beside two that say both
    for _ in range(4000):
        good = rnd.random() < 0.7
        votes = (0 if rnd.random() < (0.02 if good else 0.6) else None, *[int(good if rnd.random() < 0.9 else not good) for _ in range(2)])
        one_sided[votes] = one_sided.get(votes, 0) + 1
    model = quality_rules.fit_label_model(sorted(one_sided.items(), key=str), rules)
    bad, good = model.tables["a"]
    assert abs(bad[0] - 0.6) < 0.08 and good[0] < 0.06 and abs(model.prior - 0.7) < 0.05 and model.weight("a", None) > 0


def test_op3_posterior_is_bayes_rule_over_all_documents(spark):
    rnd = random.Random(23)
    docs = [(i, " ".join(rnd.choice(("the", "of", "and", "is", "%%", "cats.", "same same same", prose(rnd, 3))) for _ in range(rnd.randint(1, 90)))) for i in range(150)] + EDGE
    got = quality_rules.judge(spark.createDataFrame(docs, DOC)).collect()
    names = [r.name for r in quality_rules.RULES]
    votes = [tuple(r[f"vote_{n}"] for n in names) for r in got]
    start, sides = 0.8, {}
    for k, n in enumerate(names):  # plain EM, document by document
        seen = [sum(v[k] == o for v in votes) + 1.0 for o in (0, 1, None)]
        sides[n] = [[x / sum(m) for x in m] for m in ([seen[0] * start, seen[1] * (1 - start), seen[2] / 2], [seen[0] * (1 - start), seen[1] * start, seen[2] / 2])]
    first, prior = {n: [list(x) for x in s] for n, s in sides.items()}, start

    def chance(v):
        odds = math.log(prior / (1 - prior))
        for n, x in zip(names, v, strict=True):
            told = math.log(sides[n][1][(0, 1, None).index(x)] / sides[n][0][(0, 1, None).index(x)])
            odds += max(told, 0) if x == 1 else min(told, 0) if x == 0 else told
        return 1 / (1 + math.exp(-odds))

    for _ in range(200):
        p, before = [chance(v) for v in votes], prior
        prior = min(max((sum(p) + start) / (len(votes) + 1), 0.01), 0.99)
        sides = {
            n: [[x / sum(m) for x in m] for m in ([f + sum((1 - q if side == 0 else q) for q, v in zip(p, votes, strict=True) if v[k] == o) for o, f in zip((0, 1, None), first[n][side], strict=True)] for side in (0, 1))]
            for k, n in enumerate(names)
        }
        if abs(prior - before) < 1e-9:
            break
    for r, v in zip(got, votes, strict=True):
        assert abs(r["posterior"] - chance(v)) < 1e-6 and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


# --- 4, 7: sharding and packing ------------------------------------------------------


def test_op4_places_groups_evenly(spark, tmp_path):
    rnd = random.Random(6)
    docs = [(i, prose(rnd, rnd.randint(1, 60))) for i in range(600)] + [(1000 + i, "one hot text " * 5) for i in range(300)] + [(2000 + i, f"pair {i // 2}") for i in range(60)] + EDGE
    folder = table(tmp_path, "documents", spark.createDataFrame(docs, DOC))
    got = queries.op4_sharding(spark, folder).collect()
    assert len(got) == len(docs)
    text = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == text
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) == set(range(24)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    small = [sum(r["size"] for r in v) for v in shards.values()]
    assert sorted(small)[-2] < 1.3 * sum(small) / 24 or max(t[1] for t in text) > sum(small) / 24
    homes, size = {}, {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
        size[r["text_crc32"]] = size.get(r["text_crc32"], 0) + 1
    hot = zlib.crc32(("one hot text " * 5).encode())  # more rows than a shard's share
    assert all(len(v) == 1 for k, v in homes.items() if k != hot) and 1 < len(homes[hot]) <= math.ceil(24 * size[hot] / len(docs))
    assert sharding.assign_shards(spark.createDataFrame([], DOC)).count() == 0
    clash = spark.createDataFrame(docs, DOC).withColumns({c: F.lit("clash") for c in ("shard", "slot", "unit", "group", "kind", "n", "size")})
    assert sorted(map(tuple, sharding.assign_shards(clash).select("doc_id", "size", "shard", "slot").collect()), key=repr) == sorted(((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got), key=repr)


def test_op4_dot_product_choice():
    rnd = random.Random(31)
    kinds = [(k, rnd.choice((1, 1, 1, 7, 400)), tuple(float(rnd.randint(1, 50)) for _ in range(3))) for k in range(40)]
    placed = sharding.pack_kinds(kinds, 5)
    assert {k: sum(v) for k, v in placed.items()} == {k: n for k, n, _ in kinds}
    items = [(k, v) for k, _, v in kinds]  # of one item each: the rule as a plain loop
    total, left, want = [sum(v[d] for _, v in items) for d in range(3)], [[1.0] * 3 for _ in range(5)], {}
    unit = {k: [x / t * 5 for x, t in zip(v, total, strict=True)] for k, v in items}
    for k, v in sorted(unit.items(), key=lambda x: (-max(x[1]), x[0])):
        room = [b for b in range(5) if all(have >= x - 1e-12 for have, x in zip(left[b], v, strict=True))]
        score = (lambda b: sum(x * y for x, y in zip(left[b], v, strict=True))) if room else (lambda b: min(x - y for x, y in zip(left[b], v, strict=True)))  # noqa: B023
        want[k] = max(room or range(5), key=lambda b: (round(score(b), 12), -b))
        left[want[k]] = [x - y for x, y in zip(left[want[k]], v, strict=True)]
    assert sharding.pack_vectors(items, 5) == want
    placed = sharding.pack_vectors([(1, (5.0, 1.0)), (2, (1.0, 5.0)), (3, (5.0, 1.0)), (4, (1.0, 5.0))], 2)
    assert placed[1] != placed[3] and placed[2] != placed[4] and sharding.pack_vectors([], 3) == {}


def padding(ends, lengths, counts):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_op7_boundaries_are_optimal_and_batches_fit(spark):
    rnd = random.Random(8)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(0, 60), rnd.randint(1, 9)))
        counts, k = [rnd.randint(1, 9) for _ in lengths], rnd.randint(1, 4)
        ends = packing.bucket_boundaries(lengths, counts, k)
        best = min(padding([*c, lengths[-1]], lengths, counts) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
        assert padding(ends, lengths, counts) == best and len(ends) <= k
    docs = [(i, prose(rnd, rnd.randint(0, 80))) for i in range(400)] + EDGE
    got = packing.pack(spark.createDataFrame(docs, DOC), budget=128, n_buckets=4).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((d, len(WORD.findall(t or ""))) for d, t in docs)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["padded_tokens"]
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    for rows in batches.values():
        assert sorted(r["batch_slot"] for r in rows) == list(range(len(rows))) and (len(rows) == 1 or sum(r["padded_tokens"] for r in rows) <= 128 or rows[0]["padded_tokens"] == 0)
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0
    clash = spark.createDataFrame(docs, DOC).withColumns({"bucket": F.lit("clash"), "_row": F.lit("mine"), "lang": F.lit("en")})
    whole = packing.pack(clash, budget=128, n_buckets=4, keep=True)
    assert whole.columns == ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch_id", "batch_slot", "text", "_row", "lang"]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in whole.collect()))) == sorted(map(repr, docs))
    long = [(i, "w " * n) for i, n in enumerate([3_000, 3_001, 5_000, 5_003, 9_000, 9_001, 9_002, 30_000])]  # no two lengths share a bin
    ends = {r["padded_tokens"] for r in packing.pack(spark.createDataFrame(long, DOC), n_buckets=4).collect()}
    lengths = [3_000, 3_001, 5_000, 5_003, 9_000, 9_001, 9_002, 30_000]
    assert padding(sorted(ends), lengths, [1] * 8) == min(padding([*c, 30_000], lengths, [1] * 8) for c in itertools.combinations(lengths[:-1], 3))


# --- 5: n-gram Jaccard join ------------------------------------------------------------


def shingle_set(text, n):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_op5_components_of_all_pairs(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PART", 1 if percent == 90 else 64)  # 1: keys on more than eight documents are dealt over tasks
    rnd = random.Random(n)
    docs, i = [], 0
    for _ in range(14):
        words = prose(rnd, rnd.choice((1, 2, 4, 9, 30, 120))).split()
        for _ in range(rnd.randint(1, 12)):
            own = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 20))):
                own[rnd.randrange(len(own))] = prose(rnd, 1)
            docs.append((i, " ".join(own).upper() if rnd.random() < 0.1 else " ".join(own)))
            i += 1
            words = own if rnd.random() < 0.5 else words
    docs += EDGE
    sets = [shingle_set(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for x, (d, _) in enumerate(docs):
        least[top(x)] = min(d, least.get(top(x), d))
    want = sorted((d, len(s), least[top(x)]) for x, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))
    df = spark.createDataFrame(docs, DOC).repartition(3)
    assert sorted(map(tuple, ngram_join.similarity_groups(df, n, percent).collect())) == want
    if n == 5:
        kept = ngram_join.keep_one_of_each(df, n, percent)
        assert kept.columns == ["doc_id", "text"] and kept.count() == len({top(x) for x in range(len(docs))})
        assert ngram_join.similarity_groups(df.limit(0), n, percent).count() == 0


def test_op5_ids_that_repeat_or_are_null(spark):
    rnd = random.Random(21)
    one, two, other = ([prose(rnd, 1) for _ in range(60)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "changed"])
    docs = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (None, " ".join(other)), (4, near(other)), (5, "alone " * 3)]
    sets = {t: shingle_set(t, 3) for _, t in docs}
    got = ngram_join.similarity_groups(spark.createDataFrame(docs, DOC).repartition(3), 3, 90).collect()
    ids = [1, 1, 1, 1, 4, 4, 5]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, len(sets[t]), c)) for (d, t), c in zip(docs, ids, strict=True))


def test_texts_longer_than_a_chunk(spark):
    import pyarrow as pa

    from concord.llm import shingles

    long = " ".join(f"w{i % 90_000}" for i in range(120_000))
    assert len(long) > shingles.CHUNK
    sets = list(shingles.shingle_sets(pa.array(["a b c", long, None, "a b c d"]), 3))
    assert [len(s) for s in sets] == [1, 90_000, 0, 2] and set(sets[0]) < set(sets[3])
    rnd = random.Random(41)
    passage, body = prose(rnd, 200), "".join(rnd.choice("abcdefgh ") for _ in range(shingles.CHUNK + 1000))
    docs = [(1, body + "1" + passage + "2"), (2, "3" + passage + "4"), (3, body[:390])]
    got = {r["doc_id"]: r for r in suffix_dedup.repeat_digests(spark.createDataFrame(docs, DOC)).collect()}
    assert got[1]["text"] == body + "12" and got[2]["text"] == "34" and got[3]["text"] == body[:390]
    wide = "x" * (toxicity.CHUNK + 10) + " zork"
    held = list(toxicity.held_features(pa.array(["zork", wide, None, "zork"]), np.ones(1 << toxicity.BITS, dtype=bool)))
    assert set(held[0]) == set(held[3]) and len(set(held[0]) - set(held[1])) <= 1 and not len(held[2])


def test_op5_schemes_share_enough_keys():
    rnd = np.random.default_rng(3)
    for percent in (80, 90):
        schemes = ngram_join.Schemes(percent)
        for size in (3, 9, 14, 40, 90, 300, 900):
            a = np.unique(rnd.integers(0, 2**63, size * 2, dtype=np.uint64))[:size]
            gone = int(size * (100 - percent) / 100)
            b = np.sort(a[gone:])
            if 100 * len(b) < percent * len(a) or not len(b):
                continue
            both = [s for s in schemes.of(len(a)) if s in schemes.of(len(b)) and s.low <= len(b) <= s.high]
            assert both or gone == 0 or schemes.scheme(schemes.band_of(len(b))).differ == 0
            assert all(len(np.intersect1d(ngram_join.keys_of(a, s), ngram_join.keys_of(b, s))) >= s.shared for s in both)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}


def test_op5_exchanges_all_keys_once(spark, monkeypatch):
    rnd = random.Random(12)
    base = prose(rnd, 120)
    docs = spark.createDataFrame([(k, f"{base} {prose(rnd, k % 5)}") for k in range(60)], "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PART", 1)  # keys on more than eight documents are dealt over tasks
    plans, real = [], ngram_join.materialize

    def seen(df, tag):
        if tag != "shared-keys":
            return real(df, tag)
        plans.append((df.count(), df.collect(), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))
        raise InterruptedError

    monkeypatch.setattr(ngram_join, "materialize", seen)
    with pytest.raises(InterruptedError):
        ngram_join.similarity_groups(docs, 3, 90)
    n, rows, plan = plans[0]
    assert n == len(rows) > 60 and plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1


# --- 6: WARC ------------------------------------------------------------------------------


def test_op6_resolution_and_headers(spark):
    rec = lambda i, kind, uri, ts, etag=None, mod=None, **h: (i, kind, uri, ts, etag, mod, {k.replace("_", "-"): v for k, v in h.items()})
    rows = [
        rec("r1", "response", "http://www.a.com/x?b=2&a=1", "2024-01-01 00:00:00", '"1"', None, Content_Type="t", Date="d1"), rec("r2", "response", "https://A.com:443/x/?a=1&b=2&utm_source=q#f", "2024-01-05 00:00:00", '"2"', "m"),
        rec("v1", "revisit", "http://a.com/x?a=1&b=2", "2024-01-04 00:00:00", 'W/"1"', None, Date="d2", Content_Length="0"), rec("v2", "revisit", "http://a.com/x?a=1&b=2", "2024-03-01 00:00:00", '"1"'),
        rec("v3", "revisit", "http://a.com/x?a=1&b=2", "2024-01-05 00:00:00"), rec("v4", "revisit", "http://a.com/x?a=1&b=2", "2024-02-01 00:00:00", None, "m"), rec("v5", "revisit", "http://a.com/y", "2024-02-01 00:00:00", '"1"'),
        rec("v6", "revisit", None, "2024-02-01 00:00:00", '"1"'), rec("v7", "revisit", "http://a.com/x?a=1&b=2", None, '"1"'), rec("v1", "revisit", "http://a.com/x?a=1&b=2", "2024-01-04 00:00:00", 'W/"1"', None, Date="d2"),
    ]
    schema = "record_id string, warc_type string, uri string, ts string, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    got = warc.resolve_revisits(df.withColumn("url", F.lit("clash"))).collect()
    assert len(got) == 8
    by = {r["record_id"]: r for r in got}
    assert {k: (r["response_id"], r["verdict"]) for k, r in by.items()} == {
        "v1": ("r1", "etag"), "v2": ("r2", "changed"), "v3": ("r1", "unchecked"), "v4": ("r2", "last_modified"), "v5": (None, "missing"), "v6": (None, "missing"), "v7": (None, "missing"),
    }
    assert by["v1"]["headers"] == {"content-type": "t", "date": "d2"} and by["v2"]["headers"] is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    rows = [("r1", "response", "a.com", "2024-01-01 00:00:00", '"1"', None, {"ETag": "1", "etag": "2", "Via": "x", "VIA": None}), ("v1", "revisit", "a.com", "2024-01-02 00:00:00", '"1"', None, {"DATE": "d", "Date": "e"}), ("v2", "revisit", "a.com", "2024-01-03 00:00:00", '"1"', None, None)]
    got = {r["record_id"]: r["headers"] for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))).collect()}
    assert got == {"v1": {"etag": "1", "via": None, "date": "d"}, "v2": {"etag": "1", "via": None}}


# --- 8: embeddings ---------------------------------------------------------------------------


def test_op8_links_of_all_pairs(spark):
    rnd = np.random.default_rng(4)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            centre = rnd.normal(size=8)
            for _ in range(rnd.integers(1, 14)):
                rows.append((i, [float(np.float32(x)) for x in centre + rnd.normal(size=8) * rnd.choice((0.0, 0.15, 0.4))], label))
                i += 1
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [float("nan")] * 8, 1), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1), (506, [], 1), (500, rows[0][1], 1)]
    got = embedding_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93, block_bytes=512).collect()
    ok = lambda r: r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    cosine = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    n, root = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if ok(x) and ok(y) and x[2] == y[2] and len(x[1]) == len(y[1]) and cosine(np.array(x[1]), np.array(y[1])) >= 0.93:
            n[a], n[b] = n[a] + 1, n[b] + 1
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(r[0], least.get(root[k], r[0]))
    want = sorted((r[0], n[k], least[root[k]], least[root[k]] == r[0]) for k, r in enumerate(rows))
    assert sorted(map(tuple, got)) == want
    assert embedding_join.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_op8_extreme_lengths_and_many_sizes(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e200, 2e200], 1), (3, [2e-310, 4e-310], 1), (4, [1e200, -1e200], 1), (5, [1.0], 1)]
    rows += [(100 + 2 * n + k, [1.0 + k * 1e-4] + [0.5] * n, 2) for n in range(2, 60) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit("clash"), "size": F.lit(1)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.link_vectors(df).collect()}
    want = {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)} | {100 + 2 * n + k: (1, 100 + 2 * n) for n in range(2, 60) for k in (0, 1)}
    assert got == want


# --- 9: toxicity -------------------------------------------------------------------------------


def test_op9_held_out_accuracy_and_edges(spark, tmp_path):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        bad = rnd.random() < 0.25
        words = prose(rnd, rnd.randint(20, 80)).split()
        for _ in range(rnd.randint(1, 4) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(("Zorkle", "quimbat")))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    folder = table(tmp_path, "documents", spark.createDataFrame([*docs, *EDGE], DOC))
    table(tmp_path, "labels", spark.createDataFrame([*labels, (3, 1, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int"))
    got = queries.op9_toxicity(spark, folder).collect()
    assert len(got) == len(docs) + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {d: y for d, _, y in labels}
    away = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in away) >= 0.95 * len(away)
    model = toxicity.train(spark.createDataFrame(docs, DOC), spark.createDataFrame([], "doc_id long, toxic int"))
    clash = spark.createDataFrame(EDGE, DOC).withColumns({"score": F.lit("clash"), "toxic": F.lit(1)})
    assert {round(r["score"], 6) for r in toxicity.score(clash, model).collect()} == {0.5}


# --- 10: mixing -------------------------------------------------------------------------------------


def test_op10_budgets():
    caps = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 200.0}
    tree = mixing.build_tree(caps, {("a",): 1.0, ("b",): 1.0})
    assert mixing.leaf_budgets(tree, 100) == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "z"): 50.0}  # the shortage of x goes to its sibling first
    assert mixing.leaf_budgets(mixing.build_tree(caps), 300) == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 190.0}
    assert sum(mixing.leaf_budgets(mixing.build_tree(caps), 9_999).values()) == 310
    assert mixing.leaf_budgets(mixing.build_tree(caps, {("b",): 0.0}), 400) == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 0.0}


def test_op10_draws_prefixes_of_epochs(spark):
    rnd = random.Random(12)
    docs = [(i, prose(rnd, rnd.randint(0, 30)), rnd.choice(("p", "q", None))) for i in range(300)] + [(d, t, "q") for d, t in EDGE]
    df = spark.createDataFrame(docs, DOC + ", source string")
    tokens = {}
    for _, t, s in docs:
        tokens[s] = tokens.get(s, 0) + len(WORD.findall(t or ""))
    budget = int(1.2 * sum(tokens.values()))
    got = mixing.mix(df.withColumn("epoch", F.lit(9)), {"source": F.col("source")}, budget, {("p",): 3.0}, max_epochs=2, cell_rows=16).collect()
    caps = {(s,): 2.0 * n for s, n in tokens.items()}
    want = {p[0]: round(b) for p, b in mixing.leaf_budgets(mixing.build_tree(caps, {("p",): 3.0}), budget).items()}
    for s, n in tokens.items():
        rows = sorted((r["epoch"], r["end_token"], r["n_tokens"]) for r in got if r["source"] == s)
        for e in {r[0] for r in rows}:
            run = 0
            for _, end, size in (r for r in rows if r[0] == e):
                run += size
                assert end == run
            left = want[s] - e * n
            assert run == n if left >= n else run >= left > run - max(r[2] for r in rows if r[0] == e)
    assert all(r["n_tokens"] > 0 for r in got) and {r["source"] for r in got} == {"p", "q", None}
    again = mixing.mix(df.repartition(5), {"source": F.col("source")}, budget, {("p",): 3.0}, max_epochs=2, cell_rows=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # The draws one by one: each epoch in its seeded order, up to the document that reaches the budget.
    hashes = df.select("doc_id", "source", F.size(mixing.words_of(F.col("text"))).alias("n"), *[F.xxhash64(F.lit(17), F.lit(e), "doc_id", "source").alias(f"h{e}") for e in (0, 1)]).collect()
    drawn = []
    for s, n in tokens.items():
        for e in (0, 1):
            left, run = want[s] - e * n, 0
            for r in sorted((r for r in hashes if r["source"] == s and r["n"]), key=lambda r: ((r[f"h{e}"] % 2**64) >> 1, r["doc_id"], r["n"])):  # noqa: B023
                if run >= left:
                    break
                run += r["n"]
                drawn.append((r["doc_id"], s, r["n"], e, run))
    assert sorted(map(repr, drawn)) == sorted(repr((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["end_token"])) for r in got)
    assert mixing.mix(df.limit(0), {"source": F.col("source")}, 10).count() == 0
    with pytest.raises(ValueError, match="leaves"):
        mixing.mix(df, {"source": F.col("source")}, 10, max_leaves=2)
