"""The pipeline against a plain run of its stages on the smallest documents."""

import math
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_small import brute_near, words
from tidemark.llm import crf, langid, secret_scan
from tidemark.plans.checkpoints import stable


def test_registry():
    names = list(entry.queries())
    assert [sum(re.match(rf"op{n}_", q) is not None for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]


def mixed(rows):
    """Copies of each (id, text, source) row, by sorting every source whole."""
    size = {r[0]: len(words(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += size[r[0]]
    names = sorted(total)
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / sum(weight[t] for t in names if t not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in names:
        at, budget = 0, math.floor(target[s])
        epochs = budget // total[s]
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: md5(str(r[0]).encode()).hexdigest()):
            taken = epochs * size[r[0]] + min(size[r[0]], max(0, budget - epochs * total[s] - at))
            at += size[r[0]]
            out[r[0]] = math.floor(taken / max(size[r[0]], 1) + 0.5)
    return out


def test_pipeline_like_a_plain_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name in ("language", "near_duplicates", "secrets", "mix"):
        docs = stable(stages[name](spark, docs, small))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()

    model = langid.learn(spark.read.parquet(f"{small}/documents.parquet"))
    ids = sorted(before)
    known = set()
    for i in ids:
        own = [w for w in before[i][0].split() if any(map(str.isalpha, w))]
        met = []
        for w in own:
            grams = crf.featurize([crf.bare(w)], model.lexicons, model.bits).grams
            met.append(model.seen[grams].mean())
        if own and (sum(met) + 3) / (len(met) + 3) >= corpus_pipeline.LEAST_KNOWN:
            known.add(i)
    assert {r["doc_id"] for r in kept["language"]} == known

    near = brute_near([(i, before[i][0]) for i in sorted(known)], 5, 80)
    single = {i for i, _, c, _ in near if i == c}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == single

    ranks = secret_scan.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in kept["secrets"]:
        text, spans = before[r["doc_id"]][0], secret_scan.spans_of(before[r["doc_id"]][0], ranks)[1]
        covered = [False] * len(text)
        for s, e, _ in spans:
            covered[s:e] = [True] * (e - s)
        assert r["text"].replace("[secret]", "") == "".join(c for c, hidden in zip(text, covered) if not hidden) and r["n_chars"] == len(r["text"])

    copies = mixed([(r["doc_id"], r["text"], r["source"]) for r in kept["secrets"]])
    assert Counter(r["doc_id"] for r in kept["mix"]) == Counter({i: n for i, n in copies.items() if n})

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    text = {r["doc_id"]: r["text"] for r in kept["secrets"]}
    rows = corpus_pipeline.run(spark, small).collect()
    encoded = {i: [*plain.encode(text[i], add_special_tokens=False).ids, 0] for i in copies if copies[i]}
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter({i: n for i, n in copies.items() if n})
    assert sum(r["length"] for r in rows) == sum(len(encoded[i]) * copies[i] for i in encoded)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(encoded[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes())


FOREIGN = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах."]


def test_language_gate(spark, small):
    """Texts in an unlearned language, random letters and letterless ones go; known and mixed ones and single words stay."""
    learned = spark.read.parquet(f"{small}/documents.parquet")
    rnd = np.random.default_rng(2)
    by = {r["lang"]: r["text"] for r in learned.filter("n_chars between 300 and 900 and lang is not null").collect()}
    noise = " ".join("".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40))
    stay = [*by.values(), " ".join(by.values()), "\n".join(t for pair in zip(*(t.split(". ") for t in list(by.values())[:2])) for t in pair), "the"]
    go = [*FOREIGN, noise, "123 456 !!", "", None]
    rows = [(10 ** 6 + i, t) for i, t in enumerate(stay + go)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    model = langid.learn(learned)
    kept = {r["doc_id"] - 10 ** 6 for r in langid.keep(more, model, corpus_pipeline.LEAST_KNOWN).collect()}
    assert kept == set(range(len(stay)))
    assert langid.keep(more, None, corpus_pipeline.LEAST_KNOWN).count() == 0


def test_one_id_with_two_texts(spark, small):
    """A text without any copy stays though another one under its id is a near copy."""
    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(40))
    rows = [(1, base), (2, base + " more"), (2, other), (3, other), (3, other), (4, None), (None, base), (5, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert kept.columns == ["doc_id", "text"] and sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, base), (2, other), (4, None), (None, base)], key=repr)
