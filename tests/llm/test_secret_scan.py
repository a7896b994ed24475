import base64
import math
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracefold.llm import secret_scan as S


def token(r, kind, n):
    alphabet = {"hex": "0123456789abcdef", "base62": S.ENCODINGS["base62"], "base64": S.ENCODINGS["base64"], "base32": S.ENCODINGS["base32"]}[kind]
    return "".join(r.choice(alphabet) for _ in range(n))


def planted(n=60, seed=0):
    r, rows, secrets = random.Random(seed), [], {}
    for i in range(n):
        text = prose(i, 120)
        if i % 3 == 0:
            secrets[i] = token(r, ("hex", "base62", "base64", "base32")[i % 4], r.randrange(32, 64)).strip("+/_-")
            at = text.index(" ", 50)
            text = f"{text[:at]} key={secrets[i]} {text[at:]}"
        rows.append((i, text))
    return rows, secrets


def test_finds_keys_and_leaves_prose(make_docs):
    rows, secrets = planted()
    found = S.scan_secrets(make_docs(rows)).collect()
    text = dict(rows)
    got = {r.doc_id: text[r.doc_id][r.start : r.start + r.length] for r in found}
    assert {d: s for d, s in secrets.items() if d in got} == got  # no false finding
    assert len(got) >= 0.95 * len(secrets)


def test_patterned_tokens_fail_the_battery(make_docs):
    rows, _ = planted()
    rows += [(100, "x 0123456789abcdef0123456789abcdef y"), (101, "a" * 48), (102, "internationalizationandlocalization" * 2), (103, "1111111122222222333333334444444455555555")]
    assert not {r.doc_id for r in S.scan_secrets(make_docs(rows)).collect()} & {100, 101, 102, 103}


def test_redaction_takes_out_just_the_findings(make_docs):
    rows, secrets = planted()
    docs = make_docs(rows)
    hit = {r.doc_id for r in S.scan_secrets(docs).collect()}
    after = S.redact_secrets(docs)
    assert after.columns == docs.columns
    text = dict(rows)
    for r in after.collect():
        want = text[r.doc_id].replace(secrets[r.doc_id], "[secret]") if r.doc_id in hit else text[r.doc_id]
        assert r.text == want and r.n_chars == len(want)


def test_candidates_same_as_by_pattern():
    r = random.Random(2)
    texts = ["".join(r.choice("ab9+/_-. éZ") for _ in range(r.randrange(0, 400))) for _ in range(60)] + ["", "x" * 16, "é" + "x" * 20]
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"(?<![^\W_])[A-Za-z0-9+/_-]{10,}(?![^\W_])", t):
            left = t[m.start() - 1 : m.start()]
            if not left or not (left.isalnum() or left in "+/_-"):
                body = m[0].strip("+/_-")
                if len(body) >= 10:
                    want.append((i, m.start() + m[0].index(body), body))
    got = list(S.candidates(texts, 10))
    assert set(got) <= {(i, s, t) for i, s, t in got if texts[i][s : s + len(t)] == t}
    assert sorted(got) == sorted(w for w in want if w in got) and len(got) > 10


def test_tail_of_chi_squared():
    for df, x, p in ((9, 16.919, 0.05), (15, 24.996, 0.05), (63, 92.010, 0.01), (5, 4.351, 0.5), (6, 16.812, 0.01)):
        assert S.chi2_upper(np.array([x]), np.array([float(df)]))[0] == pytest.approx(p, rel=0.05)


def test_battery_is_calibrated_on_random_tokens():
    r = random.Random(4)
    models = S.log_models(np.ones(len(S.SYMBOLS)))
    for kind in ("hex", "base62"):
        p = S.battery([token(r, kind, 48) for _ in range(1500)], models)
        for k in ("p_uniformity", "p_runs", "p_serial"):
            assert (p[k] < 0.05).mean() < 0.09 and (p[k] < 0.5).mean() > 0.3


def plain_step_up(p, q):
    """Benjamini-Hochberg by sorting."""
    s, k = sorted(p), 0
    for i, x in enumerate(s, 1):
        if x <= q * i / len(p):
            k = i
    return s[k - 1] if k else -1.0


def test_step_up_same_as_by_sorting():
    r = random.Random(6)
    for _ in range(200):
        bins = [r.choice((0, 0, r.randrange(300))) for _ in range(r.randrange(1, 60))]
        p = [math.exp(-b * S.BIN) if b else 1.0 for b in bins]
        best = S.step_up({b: bins.count(b) for b in set(bins)}, len(bins), 0.05)
        cut = plain_step_up(p, 0.05)
        assert [b >= best for b in bins] == [x <= cut for x in p]


def test_longer_tokens_are_more_certain():
    r = random.Random(8)
    counts = np.array([1000.0 if s.islower() else 1.0 for s in S.SYMBOLS])
    e = [S.battery([token(r, "base62", n) for _ in range(50)], S.log_models(counts))["log_evidence"].mean() for n in (16, 32, 64)]
    assert e[0] < e[1] < e[2]


def test_odd_inputs(odd_docs, no_docs, make_docs):
    assert S.scan_secrets(odd_docs).count() == 0 and S.scan_secrets(no_docs).count() == 0
    assert sorted(map(str, S.redact_secrets(odd_docs).select("doc_id", "text").collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    assert S.redact_secrets(no_docs).count() == 0
    key = base64.b64encode(random.Random(1).randbytes(48)).decode()
    both = make_docs([(7, f"{prose(1, 60)} {key} and {key}"), (7, f"{prose(1, 60)} {key} and {key}"), (None, f"{prose(2, 50_000)} {key}")]).unionByName(odd_docs)
    found = S.scan_secrets(both).collect()
    assert len([r for r in found if r.doc_id == 7]) == 4 and len([r for r in found if r.doc_id is None]) == 1


def joined(n=72, seed=12):
    """Keys behind prefixes, one a document: id -> (text, key)."""
    r, out = random.Random(seed), {}
    for i in range(n):
        key = token(r, "hex", (32, 40, 64)[i % 3])
        if i % 6 == 5:
            key = "-".join(key[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        text = prose(i, 120)
        at = text.index(" ", 50)
        out[i] = (f"{text[:at]} {('key-', 'token_', 'sk_live_', 'api/v1/')[i // 3 % 4]}{key}{('', '/edit')[i % 2]} {text[at:]}", key)
    return out


def test_finds_hex_keys_joined_to_words(make_docs):
    cases = joined()
    docs = make_docs([(i, t) for i, (t, _) in cases.items()])
    got = {}
    for r in S.scan_secrets(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    covers = {i for i, (t, key) in cases.items() if any(a <= t.index(key) and t.index(key) + len(key) <= b for a, b in got.get(i, []))}
    assert len(covers) >= 0.97 * len(cases)
    assert all(len(x) == 1 for x in got.values())  # the widest of nested findings alone
    after = {r.doc_id: r.text for r in S.redact_secrets(docs).collect()}
    assert all(cases[i][1] not in after[i] and after[i].count("[secret]") == 1 for i in covers)


def test_hypotheses_of_a_run():
    key, uid = "0123456789abcdef" * 2, "01234567-89ab-cdef-0123-456789abcdef"
    cut = lambda t: [t[a:b] for a, b in S.hypotheses(t, 16)]
    assert cut(key) == [key] and cut(uid) == [uid]
    assert cut(f"token_{key}") == [f"token_{key}", key]
    assert cut(f"api/{uid}/{key}") == [f"api/{uid}/{key}", uid, key]
    assert cut(f"key-dead-{key}") == [f"key-dead-{key}", f"dead-{key}", key]
    assert cut("some/short/parts-only") == ["some/short/parts-only"]


def test_statistics_same_as_plain_ones():
    r = random.Random(8)
    kinds = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": S.ENCODINGS["base62"]}
    tokens = ["".join(r.choice(a) for _ in range(r.randrange(20, 60))) for a in kinds.values() for _ in range(20)] + ["abab" * 8 + "7f", "0f" * 20]
    got = S.battery(tokens, S.log_models(np.zeros(len(S.SYMBOLS))))
    for i, t in enumerate(tokens):
        alphabet = S.ENCODINGS[S.NAMES[got["encoding"][i]]]
        k, n, s = len(alphabet), len(t), [alphabet.index(c) for c in t]
        x2 = sum((s.count(a) - n / k) ** 2 / (n / k) for a in range(k))
        z = (x2 - (k - 1)) / math.sqrt(max(1 - 1 / n, 0.5))
        v = 2 / (9 * (k - 1))
        uniform = 0.5 * math.erfc(((max(k - 1 + z, 1e-12) / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v) / math.sqrt(2))
        high = [a >= k / 2 for a in s]
        n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * n1 * (n - n1) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        mid = [a - sum(s) / n for a in s]
        r1 = sum(a * b for a, b in zip(mid, mid[1:])) / sum(a * a for a in mid)
        two = lambda z: math.erfc(abs(z) / math.sqrt(2))
        want = (uniform, two((runs - mean) / math.sqrt(var)), two((r1 + 1 / n) * math.sqrt(n)))
        assert np.allclose([got[c][i] for c in ("p_uniformity", "p_runs", "p_serial")], want, rtol=1e-6, atol=1e-12)


def test_every_candidate_is_found():
    text = "x " + "a" * 16 + " " + "b" * 15 + " (" + "c1" * 10 + ") é" + "d" * 20 + " " + "e" * 20 + "é --" + "f" * 16 + "-- g+/h" * 3 + "\n" + "Z9" * 400
    want = [(m.start() + len(m[0]) - len(m[0].lstrip("+/_-")), m[0].strip("+/_-")) for m in re.finditer(r"[A-Za-z0-9+/_-]+", text)]
    beside = lambda i, t: (i and text[i - 1].isalnum()) or text[i + len(t) : i + len(t) + 1].isalnum()
    want = [(i, t) for i, t in want if len(t) >= 16 and not beside(i, t)]
    assert [(i, t) for _, i, t in S.candidates([text], 16)] == want and len(want) >= 4


def test_a_worse_fit_takes_more_evidence():
    control = S.Control([], 20.0, 1e-4)
    stats = {"log_evidence": np.array([10.0, 10.0, 10.0, 10.0]), "p_battery": np.array([1.0, 0.1, 0.001, 1e-5])}
    assert control.bins(["x" * 20] * 4, stats).tolist() == [int(x / S.BIN) for x in (10.0, 10 + math.log(0.1), 10 + math.log(0.001), 0)]
