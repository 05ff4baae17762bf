from pyspark.sql import functions as F

from reqloom.llm import pieces as P


def restore(rows):
    return "".join(r.text[r.overlap :] for r in sorted(rows, key=lambda r: r.piece))


def check(text, limit=2000, overlap=200):
    cuts = P.cut_points(text, limit, overlap)
    done = 0
    for i, (a, b, _) in enumerate(cuts):
        assert b - a <= limit and a <= done < b
        assert done - a <= overlap or i == 0
        done = b
    assert done == len(text)
    return cuts


def test_natural_and_forced():
    assert not any(h for *_, h in check("One sentence here. " * 400))
    assert any(h for *_, h in check("x" * 2001))
    assert any(h for *_, h in check("word " * 300 + "y" * 2500 + " word" * 300))
    # exactly the limit without a boundary needs no hard cut
    for lead in (0, 1, 7, 199, 1500, 1999):
        assert not any(h for *_, h in check("a " * lead + "z" * 2000 + " tail" * 500)), lead
        assert any(h for *_, h in check("a " * lead + "z" * 2001 + " tail" * 500)), lead


def test_many_shapes():
    import random

    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["word ", "。", "\n\n", "x" * rnd.randint(1, 80), ". ", "é", "𝄞", "　", ", "]) for _ in range(rnd.randint(1, 120)))
        for limit, overlap in ((50, 10), (30, 0), (20, 19)):
            longest, run = 0, 0
            for c in text:
                run = 0 if c in P.BOUNDARY else run + 1
                longest = max(longest, run)
            if len(text) > limit:
                assert any(h for *_, h in check(text, limit, overlap)) == (longest > limit)


def test_every_piece_makes_progress():
    import random

    got = check("A sentence here. " * 60 + "x" * 1950 + " " + "Another sentence here. " * 60)
    assert all(b - a > 500 for a, b, _ in got) and not any(h for *_, h in got)
    rnd = random.Random(7)
    for _ in range(300):
        parts = []
        while sum(map(len, parts)) < 9000:
            parts.append("Some words of a sentence. " * rnd.randint(1, 60))
            parts.append("y" * rnd.randint(300, 2500) + " ")
        text = "".join(parts)
        every = sorted({i + d for i, c in enumerate(text) if c in P.BOUNDARY for d in (0, 1)})
        done = 0
        cuts = check(text)
        for k, (_, b, hard) in enumerate(cuts):
            if b - done < 500 and k + 1 < len(cuts):
                # no boundary allows more: none further on within the limit
                assert not hard and not any(done + 500 <= x <= done + 2000 for x in every), (done, b)
            done = b


def test_hard_cuts_keep_their_overlap():
    cuts = check("x" * 9000)
    assert [a for a, _, _ in cuts] == [0, 1800, 3600, 5400, 7200]


def test_limit_in_tokens(spark):
    from reqloom.llm.tokens import VOCABULARY, encoding

    enc = encoding(VOCABULARY)
    text = "Das Gerät muss warten. The device shall wait, 等待三秒。 " * 90 + "q" * 400
    for limit, overlap in ((100, 10), (37, 0), (8, 3)):
        done = 0
        for a, b, _ in P.token_cut_points(text, limit, overlap, enc):
            assert a <= done < b and len(enc.encode_ordinary(text[a:b])) <= limit
            assert len(enc.encode_ordinary(text[a:done])) <= overlap + 2
            done = b
        assert done == len(text)
    df = spark.createDataFrame([("t", 1, text)], "item_table string, item_id long, text string")
    assert restore(P.split_items(df, 100, 10, vocabulary=VOCABULARY).collect()) == text


def test_prefers_paragraphs():
    text = "a. " * 500 + "\n\n" + "b. " * 500
    assert P.cut_points(text)[0][1] == 1502


def test_operator(spark):
    long = "Sentence one. " * 300
    df = spark.createDataFrame([("t", 1, long, "x"), ("t", None, long + "z" * 3000, "y")], "item_table string, item_id long, text string, piece string")
    got = P.split_items(df).collect()
    assert restore([r for r in got if r.item_id == 1]) == long
    assert restore([r for r in got if r.item_id is None]) == long + "z" * 3000
    assert {r.item_id for r in got if r.hard} == {None}
    assert P.split_items(df.limit(0)).count() == 0


def test_bad_parameters(spark):
    import pytest

    with pytest.raises(ValueError):
        P.piece_column(100, 100, True)
    assert spark.range(1).select(F.lit(1)).count() == 1
