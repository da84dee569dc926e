"""The patterns, the field and its decoding against brute force; held-out gain of the field."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from histora.llm import secret_spans as S

SF = "/root/testdata/sf0.1"


def plain_patterns(text):
    """By code points, as the contract states them."""
    out = []
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    telling = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    for m in re.finditer(rf"""({telling})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] if len(m[2]) >= 12 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def some_texts():
    rng = random.Random(8)
    parts = ["token", "PassWord", "api_key", "APIkey", "ſecret", "secret", " = ", ": ", "=", '"', "'", " ", "é", "日本", "AKIA", "ABCD1234EFGH567", "0123456789abcdef", "deadbeef", "x" * 12, "\n", "K", "a/b+c-d_e.f=", "AKIAAKIA"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(600)]


def random_field(seed=0):
    rng = np.random.default_rng(seed)
    return S.Field(rng.normal(size=(len(S.AT), S.N_FEATURES, 3)), rng.normal(size=(3, 3)))


def test_patterns():
    for t in some_texts():
        data = t.encode()
        points = lambda k: len(data[:k].decode())
        got = sorted(((S.KINDS[k], points(a), points(b)) for k, a, b in S.patterns(data)), key=lambda s: (s[1], S.KINDS.index(s[0])))
        assert got == plain_patterns(t), t


def test_tokens():
    texts = ["", "a1 b", " x=é9!!\n", "q"]
    k = S.Tokens([t.encode() for t in texts])
    joined = "".join(texts).encode()
    assert [joined[a:b].decode() for a, b in zip(k.starts, k.ends)] == ["a1", "b", "x", "=", "é9", "!", "!", "q"]
    assert k.text.tolist() == [1, 1, 2, 2, 2, 2, 2, 3] and k.gap.tolist() == [1, 1, 1, 0, 0, 0, 0, 1]
    assert len(k.sequence) == 8 + S.PAD * 5 and (k.sequence == len(k.words)).sum() == S.PAD * 5
    # equal words have equal features wherever they stand
    assert k.words.to_pylist()[k.sequence[k.at[5]]] == b"!" == k.words.to_pylist()[k.sequence[k.at[6]]]


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        for _ in range(20):
            scores, steps = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
            value = lambda tags: sum(scores[i, y] + steps[x, y] for i, (x, y) in enumerate(zip((S.OUT, *tags), tags))) + steps[tags[-1], S.OUT]
            want = max(itertools.product(range(3), repeat=n), key=value)
            for block in (1, 2, 3, 64):
                assert tuple(S.viterbi(scores, steps, block)) == want


def test_only_certain_tokens_are_skipped():
    texts = [t.encode() for t in some_texts() if t]
    for seed in range(3):
        field = random_field(seed)
        field.weights[0, :, S.OUT] += 1.5
        tokens = S.Tokens(texts)
        scores = np.full((len(tokens.sequence), 3), (0.0, -1e6, -1e6))
        scores[tokens.at] = tokens.scores(field.weights)
        tags = S.viterbi(scores, field.steps)
        want = [[] for _ in texts]
        for place, token in zip(tokens.at, range(len(tokens.at))):
            if tags[place] == S.BEGIN or (tags[place] == S.INSIDE and tags[place - 1] == S.OUT):
                want[tokens.text[token]].append([int(tokens.starts[token] - tokens.first[tokens.text[token]]), 0])
            if tags[place]:
                want[tokens.text[token]][-1][1] = int(tokens.ends[token] - tokens.first[tokens.text[token]])
        assert S.decoded(field, texts) == [[tuple(s) for s in w] for w in want]
        assert 0 < len(tokens.uncertain(field, tokens.by_word(field.weights))) < len(tokens.at)


def test_likelihood_and_slopes():
    texts = [b"token = abcdef123456 x", b"", b"a", b"no, 12!"]
    tokens, field = S.Tokens(texts), random_field(5)
    tags = np.array([0, 0, 1, 2] + [0] + [0, 0, 1, 0])
    scores = tokens.scores(field.weights)
    total, at = 0.0, 0
    for n in (4, 1, 4):
        value = lambda ys: sum(scores[at + i, y] + field.steps[x, y] for i, (x, y) in enumerate(zip((0, *ys), ys))) + field.steps[ys[-1], S.OUT]  # noqa: B023, E731
        total += value(tags[at : at + n]) - math.log(sum(math.exp(value(ys)) for ys in itertools.product(range(3), repeat=n)))
        at += n
    got, weights, steps = S.likelihood(field, tokens, tags)
    assert got == pytest.approx(total / 3)
    for x, slope in ((field.weights, weights), (field.steps, steps)):
        for place in np.argwhere(np.abs(slope) > 1e-3)[:: max(1, np.count_nonzero(np.abs(slope) > 1e-3) // 12)]:
            place = tuple(place)
            kept, two = x[place], []
            for change in (1e-5, -1e-5):
                x[place] = kept + change
                two.append(S.likelihood(field, tokens, tags)[0])
            x[place] = kept
            assert (two[0] - two[1]) / 2e-5 == pytest.approx(slope[place], rel=1e-4)


def test_renamed():
    text, spans = S.renamed(b'x token = "abcdef123456" 0123456789abcdef', b"pwd")
    assert text == b'x pwd = "abcdef123456" 0123456789abcdef' and [text[a:b] for a, b in spans] == [b"abcdef123456", b"0123456789abcdef"]
    assert S.renamed(b"plain", b"pwd") is None


def test_held_out(spark):
    """Fitted on half of the documents, the field finds the others' secrets, also behind words it wasn't told, and little else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    field = S.fit(docs.where("doc_id % 2 = 0"))
    rows = [r.text.encode() for r in docs.where("doc_id % 2 = 1 AND text IS NOT NULL").collect()]
    held = [t for t in rows if S.ASSIGN.search(t) and S.values(t)]
    unnamed = [S.ASSIGN.sub(lambda m: b"session" + m[0][len(m[1]) :], t) for t in held]
    hits = lambda texts, spans: np.mean([any(x < b and a < y for x, y in got) for got, t in zip(S.decoded(field, texts), texts) for a, b in spans(t)])
    assert len(held) > 30 and hits(held, S.values) > 0.95
    values = [[(m.start(), m.end()) for m in re.finditer(rb'(?<=session = ")[0-9A-Fa-f]{40}', t)] for t in unnamed]
    found = S.decoded(field, unnamed)
    assert np.mean([any(x < b and a < y for x, y in got) for got, v in zip(found, values) for a, b in v]) > 0.9
    clean = [t for t in rows if not S.patterns(t)]
    assert sum(map(bool, S.decoded(field, clean))) < 0.01 * len(clean)


def test_table(spark):
    texts = [None, "", "é token = 'abcdefABCDEF123' é", "password=short", "0123456789abcdef" * 3, "word " * 60_000 + "AKIA" + "Q7" * 9, "secret: " + "ab12" * 8]
    docs = spark.createDataFrame([(t, i, "clash", {"k": 1}) for i, t in enumerate(texts)] + [(texts[2], 2, None, None), (texts[2], None, None, None)], "text string, doc_id long, spans string, `a.b` map<string,int>")
    field = S.fit(docs)
    for f in (field, None):
        rows = S.found_spans(docs, f).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            text = texts[2] if r.doc_id is None else texts[r.doc_id]
            assert [tuple(s) for s in r.spans if s.kind != "crf"] == plain_patterns(text or "")
    assert S.found_spans(docs.limit(0), field).count() == 0
    assert S.fit(docs.limit(0)) is None and S.fit(docs.where("doc_id < 2")) is None


def test_query(spark, tmp_path):
    texts = some_texts()[:300] + [None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in S.op11_secrets(spark, str(tmp_path)).collect():
        want = plain_patterns(texts[r.doc_id] or "")
        joined = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == joined
