"""Every registered query and every stage of the pipeline, over the whole smallest tables, against brute force."""

import collections
import hashlib
import itertools
import math
import os
import zlib

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from test_llm import MODEL, SYLLABLES, WORD, brute_random, crc, link_facts, plain_base, plain_feature

from quillstream.llm import common, language, lm_scoring, pii, quality, registry, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="module")
def texts(spark):
    """doc_id to text; ids are unique here."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(out) == len(rows) > 100
    return out


def run(spark, name):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, SF).collect()}


def test_every_query_is_here():
    here = {k for k in registry.QUERIES if f"test_{k}" in globals()}
    assert here == set(registry.QUERIES) and len(here) == 10


def test_op1_lm_scoring(shared, texts):
    got = run(shared, "op1_lm_scoring")
    train = {i: t for i, t in texts.items() if crc(i, 7) != 2}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: [*WORD.findall(low(t)), None]
    c = collections.Counter(w for t in train.values() for w in tokens(t))
    total = sum(c.values())
    keys = lambda ts: lm_scoring._keys(*common.utf8(pa.array(ts, pa.string())), 5)[0]
    grams, n = np.unique(keys(list(train.values())), return_counts=True)
    tree = lm_scoring.ContextTree(lm_scoring._levels(grams, n.astype(float), 0, 5))
    bits = size = 0
    for i, t in texts.items():
        r = got.pop(i)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in tokens(t)), rel=1e-9)
        assert r["score"] == pytest.approx(float(tree.log10_probability(keys([t])).sum()), rel=1e-6)
        if r["held_out"]:
            bits, size = bits - r["score"] / math.log10(2), size + len(t.encode()) + 1
    # Held-out texts cost far less than eight bits a byte.
    assert not got and 0 < bits / size < 3.5


def test_op2_mixing(shared):
    assert oracle.compare(shared, oracle.connect(SF), registry.QUERIES["op2_mixing"], registry.ORACLE_SQL["op2_mixing"], SF) is None


def test_op3_secret_scan(shared, texts):
    encode = secrets.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    got = run(shared, "op3_secret_scan")
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = plain_base(t)
        known = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base)]
        every = sorted(known + brute_random(t, known, encode), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in every)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]


def test_op4_embedding_near_dedup(shared):
    rows = shared.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in registry.op4_embedding_near_dedup(shared, SF).collect()}
    want = {i: (n, c) for i, n, c in link_facts([r["vec_id"] for r in rows], linked)}
    assert set(got) == set(want) and all(got[i]["n_links"] <= want[i][0] for i in want)
    asked = [i for i in want if i % 20 == 0]
    assert sum(got[i]["n_links"] for i in want) >= 0.9 * sum(n for n, _ in want.values())
    assert sum(got[i]["component_id"] == want[i][1] for i in asked) >= 0.9 * len(asked)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op5_quality(shared, texts):
    """Posteriors against expectation-maximisation over single rows; scores against the scorer's plain formula."""
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs)
    got = run(shared, "op5_quality")
    assert set(got) == set(texts)
    votes = np.concatenate([quality.cast_votes(s) for s in quality._shapes(pa.array([t for t in texts.values() if WORD.search(t)]))])
    p, n = np.unique(quality._pattern(votes), return_counts=True)
    one = quality.expectation_maximisation(quality._pattern(votes), np.ones(len(votes)))
    many = quality.expectation_maximisation(p, n)
    assert np.allclose(one[1], many[1]) and one[2] == pytest.approx(many[2]) and np.allclose(one[1], model["chance"])
    prior = math.log(model["prior"] / (1 - model["prior"]))
    for i, t in texts.items():
        f = collections.Counter(itertools.chain.from_iterable(s.features()[0].tolist() for s in quality._shapes(pa.array([t]))))
        n_words, value = sum(f.values()), model["bias"]
        assert n_words == len(WORD.findall(t))
        for place, k in f.items():
            value += model["weights"][place] * math.sqrt(k / (n_words + quality.SMOOTH))
        sure = n_words / (n_words + quality.SMOOTH) if n_words >= 4 else 0.0
        want = 1 / (1 + math.exp(-(value * sure + prior * (1 - sure)))) if n_words else 0.0
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["kept"] == (got[i]["score"] >= 0.5)
    labels = {r["doc_id"]: r["quality"] for r in shared.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(got[i]["kept"] == (q == 1) for i, q in labels.items() if i in got) >= 0.95 * len(labels)


def similarities(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = np.zeros((len(sets),) * 2, bool)
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        linked[a, b] = linked[b, a] = both > 0 and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)
    return linked


def test_op6_ngram_join(shared, texts):
    got = run(shared, "op6_ngram_join")
    want = link_facts(list(texts), similarities(list(texts.values())))
    assert sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in got.values()) == sorted(want) and sum(n > 0 for _, n, _ in want) > 5


def plain_grams(text, bits):
    """Hashed n-grams of one text, character by character."""
    codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    mask, out = 0xFFFFFFFF, []
    for n in (1, 2, 3):
        for k in range(len(codes) - n + 1):
            h = 0
            for j in range(n):
                h = (codes[k] if j == 0 else h ^ (codes[k + j] + j + 1 & mask)) * 0x9E3779B1 & mask
                h ^= h >> 15
            if n > 1 or codes[k]:
                out.append((h * 0x85EBCA6B & mask) >> (32 - bits))
    return out


def test_op7_language_id(shared, texts):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    held = registry.fold(4) == 2
    model = language.fit(docs.where(~held))
    seen = collections.Counter(x for r in docs.where(~held).where("lang is not null").collect() for x in set(plain_grams(r["text"] or "", model["bits"])))
    df = {r["feature"]: r["n"] for r in language.document_frequencies(docs.where(~held).where("lang is not null"), model["bits"]).collect()}
    assert df == seen
    got = run(shared, "op7_language_id")
    right = n = 0
    for i, t in texts.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        grams = plain_grams(t, model["bits"])
        logits = sum((model["weights"][g].astype(float) for g in grams), np.zeros(len(model["langs"]))) / len(grams) / model["temperature"]
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[i]["score"] == pytest.approx(p.max(), abs=1e-6) and got[i]["lang_pred"] == model["langs"][int(p.argmax())]
    for r in docs.where(held).where("lang is not null").collect():
        if any(c.isalpha() for c in r["text"] or ""):
            n, right = n + 1, right + (got[r["doc_id"]]["lang_pred"] == r["lang"])
    assert right >= 0.95 * n and n > 20


def test_op8_media_columns(shared, texts):
    got = run(shared, "op8_media_columns")
    assert set(got) == set(texts)
    for i, t in texts.items():
        b = t.encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        rows, mean, std, entropy, hist = plain_feature(p)
        assert r["feature"].startswith(f"{rows}x64;mean={mean:.6f};") and r["feature"].endswith(";hist=" + ".".join(map(str, hist)))
        runs = [" ".join(x for x in line.replace("\t", " ").replace("\f", " ").replace("\r", " ").split(" ") if x) for line in t.split("\n")]
        assert r["position"] == (runs[0] != "") and r["caption"] == f"{len(b)} bytes"
        runs = [x for x in runs if x]
        assert r["n_items"] == len(runs) + 1 and r["runs_sha256"] == hashlib.sha256("\n".join(runs).encode()).hexdigest()
    of = collections.defaultdict(set)
    for i, r in got.items():
        of[texts[i]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(x) == 1 for x in of.values()) and len({x for s in of.values() for x in s}) == len(of)


def test_op9_pieces(shared, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = run(shared, "op9_pieces")
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and got[i]["covered_bytes"] == len(t.encode())


def test_op10_pii(shared, texts):
    """All values found by plain patterns are changed, all else stays, and the key gives every text back."""
    coded = registry.op10_pii(shared, SF).cache()
    got = {r["doc_id"]: r for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in pii.restore(coded, "example key").collect()}
    assert set(got) == set(texts) and all((back[i] or "") == t for i, t in texts.items())
    assert "PythonUDF" not in coded._jdf.queryExecution().executedPlan().toString() and "Arrow" not in coded._jdf.queryExecution().executedPlan().toString()
    changed = 0
    for i, t in texts.items():
        n = sum(got[i][f"n_{k}"] for k in pii.KINDS)
        changed += n > 0
        assert n > 0 or (got[i]["text"] or "") == t
    assert changed > 3


def test_pipeline_stages_against_brute_force(shared, texts, tmp_path):
    import sentencepiece

    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    collect = lambda df: [r.asDict() for r in df.collect()]
    key = lambda r: tuple(map(str, r.values()))
    before = collect(docs)

    docs = common.written(stages["quality_classifier"](shared, docs, SF), "q")
    kept = collect(docs)
    scored = run(shared, "op5_quality")
    assert docs.columns == columns and sorted(map(key, kept)) == sorted(key(r) for r in before if scored[r["doc_id"]]["kept"])
    labels = {r["doc_id"]: r["quality"] for r in shared.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {i for i, q in labels.items() if q == 1} <= {r["doc_id"] for r in kept} | {r["doc_id"] for r in before if not WORD.search(r["text"] or "")}

    docs = common.written(stages["ngram_join"](shared, docs, SF), "n")
    first = collect(docs)
    facts = link_facts([r["doc_id"] for r in kept], similarities([r["text"] or "" for r in kept]))
    assert docs.columns == columns and sorted(map(key, first)) == sorted(key(r) for r, (i, _, c) in zip(kept, facts) if i == c)

    docs = common.written(stages["secret_scan"](shared, docs, SF), "s")
    clean = {r["doc_id"]: r for r in collect(docs)}
    encode = secrets.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    assert docs.columns == columns and set(clean) == {r["doc_id"] for r in first}
    marked = 0
    for r in first:
        known = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in plain_base(r["text"]))]
        want = r["text"] or ""
        spans = sorted(known + brute_random(want, known, encode))
        merged = []
        for a, b, k in sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2]))):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, k])
        for a, b, k in reversed(merged):
            want = want[:a] + f"[{k.upper()}]" + want[b:]
        marked += bool(merged)
        assert (clean[r["doc_id"]]["text"] or "") == want and clean[r["doc_id"]]["n_chars"] == (len(want) if merged else r["n_chars"])
    assert marked

    docs = common.written(stages["mixing"](shared, docs, SF), "m")
    mixed = collect(docs)
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in clean.items()}
    source = collections.Counter()
    for i, r in clean.items():
        source[r["source"]] += size[i]
    weight = dict(zip(sorted(s for s in source if s is not None) + [None] * (None in source), itertools.cycle([3, 1, 2])))
    target, open_, budget = {}, set(source), 1.5 * sum(source.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * source[s]}
        target |= {s: 2.0 * source[s] if over else level * weight[s] for s in over or open_}
        budget -= sum(target[s] for s in over)
        open_ -= over or open_
    times = collections.Counter(r["doc_id"] for r in mixed)
    taken, largest = collections.Counter(), collections.Counter()
    for i, r in clean.items():
        taken[r["source"]] += times[i] * size[i]
        largest[r["source"]] = max(largest[r["source"]], size[i])
        assert times[i] <= 2
    assert docs.columns == columns and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in source)
    assert all(r == clean[r["doc_id"]] for r in mixed)

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = collect(stages["pieces"](shared, docs, SF))
    assert collections.Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in coded) == collections.Counter((r["doc_id"], r["source"], tuple(library.encode(r["text"], add_eos=True))) for r in mixed)
    for r in coded:
        assert r["n_tokens"] == len(r["ids"]) and r["starts"][1:] == r["ends"][:-1] and r["ends"][-1] == len(clean[r["doc_id"]]["text"].encode())

    whole = [r.asDict() for r in corpus_pipeline.run(shared, SF).collect()]
    assert names == ["quality_classifier", "ngram_join", "secret_scan", "mixing", "pieces"]
    assert sorted(map(key, whole)) == sorted(map(key, coded))


def test_pipeline_tells_rows_of_one_id_apart(shared):
    """An id on a copy and on another text; repeated rows; texts that differ in white space only; a null id."""
    import corpus_pipeline

    a, b = (" ".join("".join(x) for x in itertools.islice(itertools.product(*[SYLLABLES["en"]] * 2, s), 60)) for s in ("xy", "qz"))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (1, a), (1, a.replace(" ", "  ")), (None, a), (4, None), (5, ""), (5, "")]
    docs = shared.createDataFrame([(i, t, "s", "en", 1) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["text"] or "") for r in dict(corpus_pipeline.STAGES)["ngram_join"](shared, docs, SF).collect())
    stays = [r for r in got if r[0][1] == 1]
    assert len(stays) == 1 and stays[0][1].split() == a.split()
    assert [r for r in got if r[0][1] != 1] == [((False, 2), b), ((False, 4), ""), ((False, 5), ""), ((False, 5), ""), ((True, None), a)]
