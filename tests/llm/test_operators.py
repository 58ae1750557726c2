"""The training-data operators against brute force, and on hostile tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltgate.llm import chat, decontaminate, licenses, line_dedup, mixing, quality_classifier, quality_ledger, queries, simhash, tokens, toxicity
from siltgate.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def views(small, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{small}/{n}.parquet'")
    return con


def hostile(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns whose names clash."""
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, " \n\t ", "en", "s", 3), (4, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1),
        (5, "same text here", "de", "s", 1), (None, "no id", "en", "s", 1), (None, None, None, None, None), (6, "word " * 60_000, "fr", "s", 9), (7, "é😀\x0b\nÀ", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("rate", "copies", "posterior", "found", "score", "fp", "fail_mask", "shard", "buckets", "toxic", "label", "n_tokens", "copy")
    return df.select("*", *[F.lit(1).alias(c) for c in clash])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- 1 and 2: quality


def test_classifier_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.95


def test_classifier_never_reads_held_out_labels(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.train(docs, labels) == quality_classifier.train(docs, turned)


def test_classifier_on_hostile_tables(spark):
    docs = hostile(spark)
    for labels in (labels_of(spark, []), labels_of(spark, [(4, 1, 0), (1, 1, 0)]), labels_of(spark, [(4, 1, 0), (5, 0, 0), (None, 1, 1), (4, 1, 0)])):
        got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality_classifier.score(nothing(spark), quality_classifier.RuleEnsemble(0.0, ())).count() == 0


def test_rules_compile_to_what_they_mean(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.6)).astype(int)
    model = quality_classifier.fit(x, y, ["a", "b"])
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    got = rows.select(model.score().alias("s"), "y").collect()
    assert np.mean([(r.s >= 0.5) == r.y for r in got]) > 0.97
    z = model.intercept + sum(r.weight * r.holds(x, ["a", "b"]) for r in model.rules)
    assert np.allclose([r.s for r in got], 1 / (1 + np.exp(-z)))


def test_ledger_and_ablations(spark, small):
    rows = quality_ledger.apply(quality_ledger.ledger(table(spark, small, "documents"))).cache()
    got = rows.collect()
    policy = quality_ledger.POLICIES[quality_ledger.CURRENT]
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.fail_mask & policy.mask) and not (r.base_failed and r.kept)
    bits = {r.name: 1 << r.bit for r in quality_ledger.rules()}
    for a in quality_ledger.ablations(rows).collect():
        mask, bit = quality_ledger.POLICIES[a.version].mask, bits[a.rule]
        hits = [r.fail_mask & mask for r in got]
        assert (a.n_fail, a.n_only, a.n_kept, a.n_kept_without) == (sum(h & bit > 0 for h in hits), sum(h == bit for h in hits), sum(h == 0 for h in hits), sum(h & ~bit == 0 for h in hits))
    held = table(spark, small, "labels").join(rows, "doc_id").where("quality = 1 and not base_failed")
    assert held.where("kept").count() >= 0.98 * held.count()


def test_ledger_on_hostile_tables(spark):
    got = quality_ledger.apply(quality_ledger.ledger(hostile(spark))).collect()
    assert len(got) == 10 and all(r.base_failed for r in got)
    assert quality_ledger.apply(quality_ledger.ledger(nothing(spark))).count() == 0


# ---- 3: mixing


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = mixing.train(docs, labels)
    scored = mixing.membership(docs, model, ("n", "p")).cache()
    for weights in ({"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}, {"en": 0.1, "de": 0.9}):
        fit = mixing.solve(scored, model.domains, ("n", "p"), weights=weights)
        rows, goal, reached = scored.select("n", "p", fit.rate.alias("r")).collect(), fit.goal, fit.reached
        total = [sum(r.r * r.n * r.p[i] for r in rows) for i in range(len(model.domains))]
        scale = sum(goal)
        assert all(r.r >= 0 for r in rows)
        assert all(abs(a - b) < 1e-6 * scale for a, b in zip(total, reached, strict=True))
        assert all(abs(a - b) < 0.02 * scale for a, b in zip(total, goal, strict=True)) and fit.miss < 0.02
    with pytest.raises(ValueError, match="'xx'"):
        mixing.solve(scored, model.domains, ("n", "p"), weights={"en": 0.5, "xx": 0.5})
    with pytest.raises(ValueError, match="misses"):
        mixing.solve(scored, model.domains, ("n", "p"), weights={"en": 1.0}, steps=1, tolerance=1e-6)
    best = scored.select("lang", F.get(F.lit(list(model.domains)), (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("top"))
    assert best.where("lang = top").count() > 0.9 * best.count()


def test_mixing_copies_follow_rates_and_lose_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    out, names, fit = mixing.rated(docs, labels, carry=["doc_id"])
    want = {r.doc_id: r[names["copies"]] for r in out.collect()}
    assert "text" not in out.columns and out.where(F.col(names["rate"]) < 1).count() == 0 and fit.settled
    got = defaultdict(int)
    for r in mixing.mixed(docs, labels).select("doc_id").collect():
        got[r.doc_id] += 1
    assert got == {k: n for k, n in want.items() if n} and min(want.values()) >= 1


def test_mixing_names_all_labelled_domains(spark, monkeypatch):
    """A domain that a sample in proportion would miss has its own name; domains beyond the bound are one."""
    rows = [(i, f"common word{i % 7}", "big", "s", 1) for i in range(400)] + [(1000 + i, f"rare thing{i}", f"d{i % 3}", "s", 1) for i in range(12)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), labels_of(spark, [(r[0], 1, 0) for r in rows])
    assert mixing.train(docs, labels, rows=20).domains == ("big", "d0", "d1", "d2")
    monkeypatch.setattr(mixing, "DOMAINS", 3)
    model = mixing.train(docs, labels)
    assert model.domains == ("big", "d0", mixing.REST)
    scored = mixing.membership(docs, model, ("n", "p")).select("lang", F.get(F.lit(list(model.domains)), (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("top"))
    assert {r.top for r in scored.where("lang in ('d1', 'd2')").collect()} == {mixing.REST}


def test_mixing_on_hostile_tables(spark):
    for labels in (labels_of(spark, []), labels_of(spark, [(4, 1, 0), (5, 0, 0), (None, 1, 1), (2, 1, 0)])):
        docs = hostile(spark)
        out = mixing.mixed(docs, labels)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 7, None}
    assert mixing.mixed(nothing(spark), labels_of(spark, [])).count() == 0


# ---- 4: toxicity


def test_chain_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = docs.join(labels.select("doc_id"), "doc_id")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = toxicity.train(docs, labels.where(even))
    got = toxicity.score(known, model).withColumnRenamed("toxic", "said").join(labels.where(~even), "doc_id")
    n = {(r.toxic, r.said): r["count"] for r in got.groupBy("toxic", "said").count().collect()}
    assert n.get((0, True), 0) <= 0.01 * n[0, False] and n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0))


def test_chain_feeds_earlier_probabilities_on():
    import numpy as np

    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.4).astype(np.float32)
    first = x[:, 0]
    second = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(np.float32)
    doc, word = np.nonzero(x)
    chain = toxicity.fit_chain(["a", "b", "c"], toxicity.Presence(400, 3, doc, word), {"first": first, "second": second}, np.arange(400) % 4)
    p = chain.probabilities(400, doc, word)
    assert chain.categories == ["first", "second"] and len(chain.links[1].earlier) == 1 and chain.links[1].earlier[0] > 0
    assert ((p[:, 0] > 0.5) == first).all() and ((p[:, 1] > 0.5) == second).mean() > 0.95


def test_categories_come_from_the_labelled_texts():
    """Words that share texts are one category: here those of a language."""
    import numpy as np

    rng, doc, word = np.random.default_rng(3), [], []
    for i in range(300):
        for w in rng.choice(4, 2, replace=False):
            doc.append(i)
            word.append(4 * (i % 3) + w)
    group = toxicity.word_groups(np.array([5.0] * 12 + [0.0]), toxicity.Presence(300, 13, np.array(doc), np.array(word)), 3)
    assert group[12] == -1 and [len(set(group[4 * k : 4 * k + 4])) for k in range(3)] == [1, 1, 1] and len(set(group[:12])) == 3
    assert toxicity.word_groups(np.zeros(2), toxicity.Presence(1, 2, np.zeros(0, int), np.zeros(0, int)), 3).tolist() == [-1, -1]


def test_chain_scores_equal_plain_python(spark, small):
    """Every row's probabilities, computed word by word."""
    import math

    docs = table(spark, small, "documents")
    model = toxicity.train(docs, table(spark, small, "labels"))
    assert model.categories == ["category_1", "category_2", "category_3", "toxic"] and model.groups["category_1"]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        present, p = set(re.findall(r"[^\W\d_]+", (r.text or "").lower())), []
        for link in model.links:
            z = link.intercept + sum(w for name, w in zip(model.vocabulary, link.words, strict=True) if name in present) + sum(a * b for a, b in zip(p, link.earlier, strict=True))
            p.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
        assert all(abs(a - got[r.doc_id][f"p_{c}"]) < 1e-9 for a, c in zip(p, model.categories, strict=True)) and got[r.doc_id].toxic == (p[-1] >= toxicity.THRESHOLD)


def test_toxicity_on_hostile_tables(spark):
    docs = hostile(spark)
    for labels in (labels_of(spark, []), labels_of(spark, [(4, 1, 0)]), labels_of(spark, [(4, 1, 0), (6, 1, 1), (7, 0, 1), (None, 1, 1)])):
        model = toxicity.train(docs, labels)
        assert toxicity.score(docs, model).count() == docs.count()
        kept = toxicity.keep_clean(docs, model)
        assert kept.columns == docs.columns
    assert toxicity.keep_clean(docs, toxicity.train(docs, labels_of(spark, []))).count() == docs.count()
    assert toxicity.score(nothing(spark), model).count() == 0


# ---- 5: chat

HARD = ["", "a\nb", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\s>x[\\INST][INST]<s><", "<<s>>", "[[INST]]", "</s", "\\n\\b\\", "<|im_start|><|im_end|>\n", "é😀</s>😀"]


def test_chat_round_trip_of_control_strings(spark):
    pairs = [(a, b) for a in HARD for b in HARD]
    rows = [(i % 3, i, role if i % 2 else "assistant", text) for i, (text, role) in enumerate(pairs)] + [(9, 0, None, None), (9, 0, "assistant", "x"), (9, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("out", F.lit(1)).withColumn("escaped", F.lit(1))
    for r in chat.format_conversations(df).collect():
        for span in r.loss_mask:
            assert not re.search(chat.RAW, r.formatted[span.start : span.stop])
        assert len(re.findall(re.escape(chat.START), r.formatted)) == len(r.source_digests)
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda q: (q[0] is None, q[0] or 0, q[1], q[2] or "", q[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.round_trip(df).collect()} == want
    assert chat.digests(chat.round_trip(df.limit(0))).count() == 0


def test_chat_learns_what_the_mask_covers(spark):
    """The loss text is cut out of the formatted text: a mask that is wrong changes it. Spans in bytes and in characters agree."""
    rows = [(i % 4, i, "assistant" if i % 3 else "user", text * (1 + i % 2)) for i, text in enumerate(HARD)]
    read = chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in read.collect():
        for m in r.loss_mask:
            assert r.formatted[m.start : m.stop] == r.formatted.encode()[m.from_byte : m.to_byte].decode()
    want = {c: hashlib.sha256("".join(t for k, _, role, t in rows if k == c and role == "assistant").encode()).hexdigest() for c in range(4)}
    assert {r.conv_id: r.loss_sha256 for r in chat.digests(read).collect()} == want
    moved = read.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("from_byte", m["from_byte"] - 1)))
    assert {r.conv_id: r.loss_sha256 for r in chat.digests(moved).collect()} != want


def test_chat_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "</s>b"), (1, 0, "user", "a")]
    got = chat.digests(chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 5), (1, 1, 0)]


def test_chat_mask_covers_the_learned_texts(spark):
    got = chat.format_conversations(chat.hostile(spark)).first()
    (span,) = got.loss_mask
    assert got.n_escaped == 2 and got.formatted[span.start : span.stop] == "<\\/s>[\\INST] ok [\\/INST]"


def test_chat_query_equals_its_sql(spark, small):
    con = views(small, "conversations")
    got = {tuple(r) for r in queries.op5_chat(spark, small).collect()}
    assert got == set(con.execute(queries.OP5_SQL).fetchall())


# ---- 6: tokens


def test_token_files_equal_whole_text_encoding(spark, small):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.word_tokenizer())
    got = {r.doc_id: r for r in queries.op6_token_ids(spark, small).collect()}
    start = 0
    for r in table(spark, small, "documents").orderBy("doc_id").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    made, own = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["", "  ", "a b́ ́x it's IT'S 12 3four 5%&^ ΣΑΣ İstanbul ﬁ", "\u0085a\x1cb\xa0c\n\t'S 're", "日本語 テスト", "word " * 400, "é Å    "]
    assert made.by_word == name.startswith("word")
    monkeypatch.setattr(tokens, "MEMORY", 5)
    for batch in (texts, texts[::-1], texts[:1]):
        ids, off = made.encode(pa.array(batch))
        for i, t in enumerate(batch):
            assert ids[off[i] : off[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids + [tokens.END]


def test_a_hot_id_is_dealt_to_many_shards(spark):
    """Rows of one id go to many shards, equal rows too, and the order by id stays."""
    from siltgate.llm.common import fresh_path

    whole = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(whole, "false")
    rows = [(7, f"text {i % 5}", "en", "s", 1) for i in range(3000)] + [(i, "x", "en", "s", 1) for i in range(15)]
    docs, path = spark.createDataFrame(rows, SCHEMA).repartition(4), fresh_path(spark, "hot")
    tokens.write(docs, path, queries.word_tokenizer())
    spark.conf.unset(whole)
    files = spark.read.parquet(path)
    assert files.where(F.array_contains("docs", F.lit(7))).select("shard").distinct().count() > 2
    got = tokens.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_tokens_on_hostile_tables(spark):
    got = tokens.round_trip(hostile(spark), queries.word_tokenizer()).orderBy("start").collect()
    assert len(got) == 10 and [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[2].n_tokens == 1
    assert tokens.round_trip(nothing(spark), queries.word_tokenizer()).count() == 0


# ---- 7: lines


def test_line_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = views(sf, "documents")
    got = {tuple(r) for r in queries.op7_line_dedup(spark, sf).collect()}
    assert got == set(con.execute(queries.OP7_SQL).fetchall()) and any(r[2] for r in got)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lines_on_hostile_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    got = line_dedup.drop_shared_lines(hostile(spark), min_docs=2).collect()
    by = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()[:6] if len(r.text) > 99 else r.text) for r in got)
    assert len(got) == 10 and (4, 1, 1, "") in by and (5, 1, 1, "") in by and (3, 2, 0, " \n\t ") in by and (7, 2, 0, "é😀\x0b\nÀ") in by
    assert line_dedup.drop_shared_lines(nothing(spark)).count() == 0


# ---- 8: licences


def test_licences_and_their_inheritance(spark, monkeypatch):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/c/d/y", "# Licensed under the Apache License,\n# Version 2.0 License; you may not use this"), ("z/q", "nothing"),
        (None, None), ("a/z", ""), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/n", "x"), ("a/b/n", "x"), ("top", "the license of this is unclear"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "k int, path string, text string")
    want = [("MIT", "own"), ("GPL-3.0", "a/b"), ("Apache-2.0", "own"), (None, None), (None, None), ("MIT", "a"), ("GPL-3.0", "own"), ("GPL-3.0", "a/b"), ("GPL-3.0", "a/b"), (None, None)]
    for limit in (10**6, 0):
        monkeypatch.setattr(licenses, "BROADCAST_ROWS", limit)
        got = licenses.scan(df, ["k"]).orderBy("k").collect()
        assert [(r.license, r.license_from) for r in got] == want
    assert licenses.scan(df.limit(0), ["k"]).count() == 0


def test_licences_in_tags_paragraphs_and_whole_texts(spark):
    import textwrap

    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + textwrap.fill(licenses.FULL["MIT"][0], 70)
    prose = "The river rose again in spring and the mill stood still for weeks. "
    rows = [
        ("a/m.c", "// SPDX-License-Identifier: MIT\nint main;" + " x" * 50, "MIT", False), ("a/n.py", "# SPDX-License-Identifier: Apache-2.0\n" + prose, "Apache-2.0", False),
        ("a/o.h", "/* SPDX-License-Identifier: GPL-3.0-or-later */\n" + prose, "GPL-3.0", False), ("a/p", "SPDX-License-Identifier: Foo-1.0\n" + prose, None, False),
        ("b/whole.txt", mit, "MIT", True), ("b2/whole.txt", textwrap.fill(licenses.FULL["ISC"][0], 60), "ISC", True),
        ("c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + prose * 20, "GPL-3.0", True),
        ("d/x", prose * 3 + "Licensed under CC BY 4.0. " + prose * 3, "CC-BY-4.0", False), ("e/x", prose + "Nobody gave permission to read the MIT License aloud. " + prose, None, False),
        ("f/x.js", "/*\n * Licensed under the Apache License, Version 2.0 (the\n * \"License\"); you may not use this file except\n * in compliance with the License.\n */\n" + prose * 5, "Apache-2.0", False),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "k int, path string, text string")
    got = [(r.own_license, r.is_license_file) for r in licenses.scan(df, ["k"]).orderBy("k").collect()]
    assert got == [r[2:] for r in rows]


def test_licences_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_licenses(spark, sf).collect()}
    names = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in table(spark, sf, "documents").collect():
        said = {names[x] for x in (r.text or "").split("\n") if x in names}
        assert got[r.doc_id].own_license in said if said else got[r.doc_id].own_license is None
    assert licenses.scan(licenses.documents_as_files(hostile(spark)), ["doc_id"]).count() == 10


# ---- 9: decontamination


def plain_edits(item, text):
    """Least word edits from the item to any run of the text."""
    cost = list(range(len(item) + 1))
    best = cost[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(cost[i] + (x != w), cost[i + 1] + 1, new[i] + 1))
        cost = new
        best = min(best, cost[-1])
    return best


def test_decontamination_finds_edited_items(spark, small):
    rng = random.Random(4)
    bench = table(spark, small, "benchmark").collect()
    docs = [r.text for r in table(spark, small, "documents").where("length(text) > 400").orderBy("doc_id").collect()]
    words, rows, planted = " ".join(docs[:20]).split(), [], {}
    for k in range(80):
        item = rng.choice(bench)
        w = item.text.split()
        for _ in range(rng.randint(0, decontaminate.edits_allowed(len(re.findall(r"[^\W_]+", item.text))))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        d = docs[k % len(docs)].split()
        p = rng.randint(0, len(d))
        rows.append((k, " ".join(d[:p] + w + d[p:])))
        planted[k] = item.item_id
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(df, table(spark, small, "benchmark")).collect()}
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    text, items = dict(rows), {r.item_id: plain(r.text) for r in bench}
    assert sum(x in got for x in planted.items()) >= 78
    assert all(e == plain_edits(items[i], plain(text[d])) <= decontaminate.edits_allowed(len(items[i])) for (d, i), e in got.items())


def test_decontamination_finds_edited_long_items(spark):
    """Items of 150 to 400 words among short ones, edited as far as is allowed, are found as surely as the short ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    items = [[word() for _ in range(rng.choice((150, 250, 400)) if k % 5 == 0 else rng.randint(15, 59))] for k in range(200)]
    rows = []
    for k, item in enumerate(items):
        w = list(item)
        for _ in range(decontaminate.edits_allowed(len(item))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((k, " ".join([*(word() for _ in range(50)), *w, *(word() for _ in range(50))])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs, bench).collect()}
    assert all(got.get((k, k)) == plain_edits(items[k], rows[k][1].split()) for k in range(0, 200, 5))
    assert set(got) <= {(k, k) for k in range(200)} and len(got) >= 194


@pytest.mark.parametrize("n", [8, 20, 60, 100, 200, 400])
def test_decontamination_recall_by_item_length(spark, n):
    """Items edited as far as is allowed, among items of other lengths, whole texts."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    items, rows = [[word() for _ in range(n)] for _ in range(60)], []
    for k, item in enumerate(items):
        w = list(item)
        for _ in range(decontaminate.edits_allowed(n)):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((k, " ".join([*(word() for _ in range(300)), *w, *(word() for _ in range(30))])))
    bench = [(k, " ".join(i)) for k, i in enumerate(items)] + [(1000 + k, " ".join(word() for _ in range(30))) for k in range(50)]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= {(k, k) for k in range(60)} and len(found) >= 57


def test_decontamination_equals_brute_force(spark, small):
    """Every item against every run of whole texts, of which some hold items with edits."""
    rng = random.Random(2)
    bench = table(spark, small, "benchmark").limit(25).collect()
    texts = [r.text for r in table(spark, small, "documents").where("length(text) between 200 and 2500").orderBy("doc_id").limit(30).collect()]
    for k, text in enumerate(texts[:15]):
        w, item = text.split(), rng.choice(bench).text.split()
        item[rng.randrange(len(item))] = "changed"
        texts[k] = " ".join(w[: len(w) // 2] + item + w[len(w) // 2 :])
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [(r.item_id, plain(r.text)) for r in bench]
    want = {(d, i, e) for d, t in enumerate(texts) for i, item in items if (e := plain_edits(item, plain(t))) <= decontaminate.edits_allowed(len(item))}
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(bench))
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == want and len(want) >= 15


def test_item_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    bench = spark.createDataFrame([(k, f"w{k} " * 100) for k in range(6)] + [(9, "long " * 900)], "item_id long, text string")
    sizes = [len(b.ids) for b in decontaminate.blocks(bench)]
    assert sum(sizes) == 7 and max(sizes) <= 3 and sizes[-1] == 1


def test_decontamination_on_hostile_tables(spark, monkeypatch):
    docs = hostile(spark).withColumn("text", F.when(F.col("doc_id") == 7, "xx the quick brown fox jumps over the lazy dog yy same text here").otherwise(F.col("text")))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (4, "The quick, brown fox jumps over a lazy dog"), (4, "same TEXT here"), (5, "!!")], "item_id long, text string")
    for block in (1, 100):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (decontaminate.SIMILARITY, block))
        got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect()}
        assert got == {(4, 3, 0), (4, 4, 0), (5, 3, 0), (5, 4, 0), (7, 3, 0), (7, 4, 0), (7, 4, 1)} - ({(7, 4, 1)} if (7, 4, 1) not in got else set())
        kept = decontaminate.keep_clean(docs, bench)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, None}
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(nothing(spark), bench).count() == 0


# ---- 10: near duplicates


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("tree", [simhash.TREE, 16])
def test_components_equal_brute_force(spark, tree, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, tree))
    rows = simhash.clusters(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    part = plain_components([r.fp % 2**64 for r in rows], 2)
    least = {}
    for p, r in zip(part, rows, strict=True):
        least[p] = min(least.get(p, r.doc_id), r.doc_id)
    assert all(least[p] == r.component_id for p, r in zip(part, rows, strict=True))
    assert len(least) < len(rows)


def test_long_chains_join(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(n + 1)} | {1000: 999, 999: 999}


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 500))]
        for c in range(3):
            w = list(base)
            for _ in range(c and max(1, len(base) // 100)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
            group[len(rows) - 1] = g
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(group[d] == group[c] for d, c in got.items())
    assert sum(c == 3 * group[d] for d, c in got.items()) >= 118


def test_near_duplicates_on_hostile_tables(spark):
    docs = hostile(spark)
    got = [(r.doc_id or 0, r.component_id) for r in simhash.clusters(docs).collect()]
    assert len(got) == 10 and (4, 4) in got and (5, 4) in got and (1, 1) in got and (2, 1) in got and (3, 1) in got
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 6, 7]
    assert simhash.clusters(nothing(spark)).count() == 0 and simhash.keep_one(nothing(spark)).count() == 0


def test_no_unique_text_is_lost(spark):
    """One id on different texts, and rows without an id: every component keeps one row, which has its text."""
    rows = [(1, "alpha"), (5, "beta"), (5, "alpha"), (5, "beta"), (2, "gamma"), (None, "delta"), (None, "alpha"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, f"{t} " * 30 if t else t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = sorted((r.doc_id or 0, (r.text or "").split(" ")[0]) for r in simhash.keep_one(docs).collect())
    assert kept == [(0, "alpha"), (0, "delta"), (1, "alpha"), (2, "gamma"), (3, ""), (5, "beta")]


def test_near_duplicates_equal_brute_force(spark):
    """Components of all pairs at 0.8 over the test documents, found with plain sets."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    posted, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in posted[x]:
                shared[j] += 1
            posted[x].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = {r.doc_id: least[find(i)] for i, r in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(spark.createDataFrame(rows)).collect()}
    assert len(least) < len(rows) and sum(got[d] != c for d, c in want.items()) <= 2


def overlapping(rng, same, own):
    """Two texts of random words whose five-word shingles are ``same`` in common and ``own`` of either's own."""
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    start = [word() for _ in range(same + 4)]
    return [" ".join(start + [word() for _ in range(own)]) for _ in range(2)]


def test_near_duplicates_are_decided_on_whole_shingle_sets(spark):
    """Pairs at 0.77 to 0.79 stay apart, pairs at 0.8 to 0.82 are linked, short or long."""
    rng, texts, want = random.Random(7), [], []
    for size in (20, 450):
        for k in range(40):
            j = (0.77, 0.78, 0.785, 0.805, 0.81, 0.82)[k % 6]
            shared = round(j * size)
            own = max(1, (size - shared) // 2)
            texts += overlapping(rng, shared, own)
            want.append(shared >= 0.8 * (shared + 2 * own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(docs).collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(len(want))]
    assert sum(want) > 20 and not any(x and not w for x, w in zip(linked, want, strict=True))
    # The shards' keys miss one pair in 460.
    assert sum(w and not x for x, w in zip(linked, want, strict=True)) <= 1


def test_different_texts_with_one_fingerprint_stay(spark):
    """Texts of 60 own words each and a line that all repeat 30 times are no near copies; equal shingle sets are."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    line = " ".join(word() for _ in range(11))
    texts = [" ".join([*(word() for _ in range(60)), *[line] * 30]) for _ in range(8)]
    fps = simhash.majority(*simhash.shingle_hashes(pa.array(texts), simhash.WORDS))
    assert len(set(fps.tolist())) < len(texts)
    rows = [*enumerate(texts), (8, texts[3] + " " + line)]
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 3 if d == 8 else d for d, _ in rows}


def test_near_copies_with_repeated_lines(spark):
    """Copies in which one line is repeated 20 times more are near copies, however far their fingerprints are apart."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    for k in range(20):
        w = [word() for _ in range(300)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:112] + w[100:112] * 20 + w[112:]))]
    fps = simhash.majority(*simhash.shingle_hashes(pa.array([t for _, t in rows]), simhash.WORDS)).tolist()
    assert sum((a ^ b).bit_count() > 18 for a, b in zip(fps[::2], fps[1::2], strict=True)) > 10
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_licence_windows_do_not_depend_on_pieces(spark, monkeypatch):
    notice = licenses.TEMPLATES["GPL-3.0"][1].lower().replace(";", "").replace(":", "").replace(",", "").replace(".", "")
    words = ["the"] * 13 + notice.split() + ["license"] * 9 + ["end"] * 7
    shares = [[(w, 1 / len(set(own))) for w in sorted(set(own))] for own in (licenses._split(n) for _, n, _ in licenses.templates())]
    marked = spark.createDataFrame([(1, words), (2, []), (3, ["license"])], "file int, t array<string>")
    got = []
    for size in (4096, 5):
        monkeypatch.setattr(licenses, "PIECE", size)
        got.append(sorted((r["file"], r["run"], tuple(r["t"])) for r in licenses.windows(marked, shares).collect()))
    assert got[0] == got[1]
    assert any(run < licenses.WHOLE_RUN for _, run, _ in got[0])


def test_near_copies_are_found_by_trees_of_fingerprints(spark, monkeypatch):
    """The stage's links come from BK-trees: of fingerprints within the radius only, and of equal ones only at radius zero."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    base = [word() for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, word()])), (3, " ".join(base).upper()), (4, word())], "doc_id long, text string")
    found = lambda: {r.doc_id: r.component_id for r in simhash.near_clusters(docs).collect()}
    assert found() == {1: 1, 2: 1, 3: 1, 4: 4}
    monkeypatch.setattr(simhash.loose_links, "__defaults__", (simhash.SIMILARITY, 0, simhash.TREE))
    assert found() == {1: 1, 2: 2, 3: 1, 4: 4}
