import random

import numpy as np
import pytest

from reqloom.llm import langid as G
from reqloom.llm.languages import LANGS, language_of_label

SENTENCES = {
    "en": "The modem shall stop when the network does not answer within five seconds.",
    "de": "Das Modem muss warten, wenn das Netz keine Antwort liefert und der Akku leer ist.",
    "fr": "Le modem doit attendre quand le réseau ne répond pas et que la batterie est vide.",
    "es": "El módem debe esperar cuando la red no responde y la batería está casi vacía.",
    "pt": "O modem deve esperar quando a rede não responde e a bateria está quase vazia.",
    "it": "Il modem deve attendere quando la rete non risponde e la batteria è quasi scarica.",
    "nl": "De modem moet wachten wanneer het netwerk geen antwoord geeft en de accu leeg is.",
    "sv": "Modemet ska vänta när nätet inte svarar och batteriet nästan är tomt.",
    "pl": "Modem musi czekać, gdy sieć nie odpowiada, a bateria jest prawie pusta.",
    "ru": "Модем должен ждать, когда сеть не отвечает и батарея почти разряжена.",
    "zh": "如果网络没有响应，调制解调器必须在五秒内停止所有尝试。",
    "ja": "ネットワークが応答しないときは、モデムは五秒以内に停止しなければならない。",
}


@pytest.fixture(scope="module")
def labeller():
    rnd = random.Random(1)
    texts = []
    for lang, s in SENTENCES.items():
        for _ in range(20):
            words = s.split(" ")
            if lang not in ("zh", "ja"):
                words.insert(rnd.randrange(1, len(words)), rnd.choice(words))
            texts.append(" ".join(words) + " " + s)
    return G.Labeller(*G.train(texts, rounds=30))


def test_single_languages(labeller):
    langs, sure, several = labeller.documents([s + " " + s for s in SENTENCES.values()] + [None, "", "12 34 ...", SENTENCES["en"].upper()])
    assert langs[:12] == LANGS and all(x > 0.6 for x in sure[:12])
    assert langs[12:15] == [None] * 3 and langs[15] == "en"
    assert several[:15] == [[]] * 15


def test_mixed(labeller):
    mixed = " ".join([SENTENCES["en"]] * 2 + [SENTENCES["de"]] * 2)
    one = " ".join([SENTENCES["en"]] * 3 + [SENTENCES["de"]])
    names = SENTENCES["de"] + " Danach sendet das Modem die Meldung Passive Certificate Audit an das Netz.\nThe Table\n" + SENTENCES["de"]
    _, _, several = labeller.documents([mixed, one, names])
    assert several == [["en", "de"], [], []]
    p = labeller.passages(mixed)
    assert [x[3] for x in p] == ["en", "de"] and p[0][1] == 0 and p[1][2] == len(mixed)
    assert labeller.passages("") == []


def test_passages_inside_a_sentence(labeller):
    one = "The modem shall stop when the network does not answer und danach muss das Modem warten, wenn das Netz keine Antwort liefert"
    p = labeller.passages(one)
    assert [x[3] for x in p] == ["en", "de"] and abs(p[1][1] - one.index("und danach")) <= 12
    assert p[0][1] == 0 and p[-1][2] == len(one) and all(0 < x[4] <= 1 for x in p)
    three = SENTENCES["en"] + " Quand le réseau ne répond pas. " + SENTENCES["en"]
    assert [x[3] for x in labeller.passages(three)] == ["en", "fr", "en"]
    assert labeller.passages(SENTENCES["en"]) == []
    names = "Danach sendet das Modem die Meldung Passive Certificate Audit an das Netz und wartet."
    assert labeller.passages(SENTENCES["de"] + " " + names) == []


def test_batches_and_single_texts_agree(labeller):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(list(SENTENCES.values())) for _ in range(rnd.randint(0, 6))) for _ in range(40)]
    together = labeller.label(texts, True)
    for i, t in enumerate(texts):
        alone = labeller.label([t], True)
        assert [x[i] for x in together][0] == alone[0][0] and together[2][i] == alone[2][0]
        assert [x[:4] for x in together[3][i]] == [x[:4] for x in alone[3][0]]


def test_a_sentence_is_one_chain(labeller):
    """A switch after many words is seen, and words next to it are judged by their neighbours, wherever it lies."""
    for lead in (20, 63, 64, 65, 130):
        text = " ".join(["warten"] * 0 + ["the network"] * lead) + " und danach muss das Modem warten wenn das Netz keine Antwort liefert"
        p = labeller.passages(text)
        assert [x[3] for x in p] == ["en", "de"], lead


def test_other_languages(labeller):
    finnish = "Laite odottaa verkon vastausta ja tallentaa profiilin muistiin ennen kuin ajastin päättyy, minkä jälkeen se lähettää uuden viestin palvelimelle."
    langs, _, _ = labeller.documents([finnish, SENTENCES["en"]])
    assert langs == ["other", "en"]


def test_model_is_fitted_once(spark, tmp_path):
    rows = [(i, s + " " + s, k) for i, (k, s) in enumerate(SENTENCES.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    a = G.model_of(spark, str(tmp_path))
    assert G.model_of(spark, str(tmp_path)) is a
    where = f"{tmp_path}/model.npz"
    spark.conf.set(G.MODEL, where)
    try:
        G.model_of(spark, str(tmp_path))
    finally:
        spark.conf.unset(G.MODEL)
    again = G.load_model(spark, where)
    assert all(np.array_equal(x, y) for x, y in zip(a.value, again, strict=True))
    assert G.load_model(spark, f"{tmp_path}/none.npz") is None


def test_long_text(labeller):
    langs, _, several = labeller.documents([SENTENCES["fr"] * 3000 + " " + "quand la batterie est vide " * 20000])
    assert langs == ["fr"] and several == [[]]


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    keep = G.L
    rows, trans = rng.random((6, keep)).astype(np.float32), rng.random((keep, keep)).astype(np.float32)
    ids, lengths = np.array([3, 4, 5, 1]), np.array([3, 1])
    each, moves = G.forward_backward(ids, lengths, rows, trans, grad=True)
    sums = G.sums_of(each, lengths)
    want, z = np.zeros((3, keep)), 0.0
    for y in itertools.product(range(keep), repeat=3):
        w = rows[3, y[0]] * trans[y[0], y[1]] * rows[4, y[1]] * trans[y[1], y[2]] * rows[5, y[2]]
        z += w
        for t in range(3):
            want[t, y[t]] += w
    assert np.allclose(each[:3], want / z, atol=1e-4) and np.allclose(sums[0], (want / z).sum(axis=0), atol=1e-4)
    assert np.allclose(moves.sum(), 2, atol=1e-3)
    assert np.allclose(each[3], rows[1] / rows[1].sum(), atol=1e-5)


@pytest.mark.parametrize(("label", "want"), [("en_US", "en"), ("DE", "de"), ("Deutsch", "de"), ("español", "es"), ("pt-BR", "pt"), ("zho", "zh"), (" fr ", "fr"), ("n/a", None), ("??", None), ("", None), (None, None), ("und", None), ("unknown", None), ("zh-Hans", "zh"), ("English (UK)", "en"), ("fi-FI", "fi"), ("Korean", "ko"), ("-", None), ("gb", "en")])
def test_labels(label, want):
    assert language_of_label(label) == want


def test_query(spark, tmp_path):
    s = SENTENCES
    rows = [(1, s["en"] + " " + s["en"], "en"), (2, s["de"], "en"), (3, s["fr"], None), (4, f"{s['en']} {s['en']} {s['ru']} {s['ru']}", "en"), (5, "", None), (6, None, "xx"), (7, s["ja"], "Japanese")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in G.p9_found(spark, str(tmp_path)).collect())
    assert got == [(2, "wrong", "de"), (3, "missing", "fr"), (4, "mixed", "en"), (4, "mixed", "ru")]
