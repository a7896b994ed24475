from tests.llm.conftest import prose
from tracefold.llm import lang_id as L


def labelled(n, seed=0):
    return [(i, prose(seed + i, 60, l), l) for i, l in enumerate(["en", "de", "fr", "es"] * n)]


def test_held_out_accuracy(make_docs):
    train, test = labelled(60), labelled(40, 9000)
    model = L.fit([t for _, t, _ in train], [l for *_, l in train])
    got = list(L.predict([t for _, t, _ in test], model, 3, 0.3))
    right = sum(g[0] == l for g, (*_, l) in zip(got, test))
    assert right >= 0.97 * len(test)
    assert all(g[1] == L.FAMILIES[g[0]] for g in got)


def test_scores_same_as_by_hand():
    model = L.fit([t for _, t, _ in labelled(10)], [l for *_, l in labelled(10)])
    text = prose(77, 40, "fr")
    (x,) = L.averages([text])
    fam = model.weights[: len(model.families)] @ x + model.bias[: len(model.families)]
    got = next(L.predict(["", text], model, 3, 0.3).__iter__()), list(L.predict(["", text], model, 3, 0.3))[1]
    assert got[0][5] and got[1][1] == model.families[int(fam.argmax())]
    assert abs(got[1][2] - (fam.max() - fam.min())) < 1e-4


def test_odd_inputs(odd_docs, no_docs, make_docs):
    rows = {(r.doc_id, r.rejected) for r in L.identify(odd_docs).collect()}  # no labels at all
    assert {r for _, r in rows} == {True}
    both = make_docs(labelled(20)).unionByName(odd_docs)
    got = L.identify(both).collect()
    assert len(got) == both.count()
    state = {r.doc_id: r.rejected for r in got if r.doc_id is not None and r.n_letters < 10}
    assert state[1] and state[2] and state[3] and state[6]
    kept = L.keep_identified(both)
    assert kept.columns == both.columns and kept.where("doc_id IN (1, 2, 3, 6) AND lang IS NULL").count() == 0
    assert L.identify(no_docs).count() == 0 and L.keep_identified(no_docs).count() == 0


def test_one_language_and_unknown_family():
    m = L.fit(["abc abd", "abc abe"], ["xx", "xx"])
    assert [g[:2] for g in L.predict(["abc abd"], m, 3, 0.3)] == [("xx", "other:xx")]


def test_whole_text_counts(make_docs):
    """What stands at the end of a long text bears on its language."""
    train = labelled(60)
    model = L.fit([t for _, t, _ in train], [l for *_, l in train])
    text = prose(5, 100, "en") + " " + prose(6, 20_000, "es")
    assert [g[0] for g in L.predict([text], model, 3, 0.3)] == ["es"]


def test_votes_same_as_by_hand():
    """Family first, then every pair of its languages votes; ties go by the sum of margins, then by name."""
    got = labelled(160)
    model = L.fit([t for _, t, _ in got], [l for _, _, l in got], {"en": "a", "de": "a", "fr": "a", "es": "b"})
    texts = [prose(5000 + i, 25, l) for i, l in enumerate(("en", "de", "fr", "es") * 15)]
    x = L.averages(texts).astype(float)
    score = x @ model.weights.T.astype(float) + model.bias
    for row, found in zip(score, L.predict(texts, model, 3, 0.3)):
        family = model.families[int(row[: len(model.families)].argmax())]
        votes = {l: [0, 0.0] for l in model.members[family]}
        for (a, b), s in zip(model.pairs, row[len(model.families) :]):
            if a in votes:
                votes[a if s >= 0 else b][0] += 1
                votes[a][1], votes[b][1] = votes[a][1] + s, votes[b][1] - s
        best = sorted(votes, key=lambda l: (-votes[l][0], -votes[l][1], l))[0]
        assert found[:2] == (best, family) and abs(found[3] - votes[best][1]) < 1e-3


def test_without_a_language_column(make_docs):
    docs = make_docs([(1, prose(1, 30), "en")]).drop("lang")
    assert [r.language for r in L.identify(docs).collect()] == ["und"] and L.keep_identified(docs).count() == 0
