import pytest

from reqloom.llm import pairs as P

Q = "What shall the modem do when the battery is almost empty?"
GOOD = [
    "The modem shall stop every attempt. It shall then return to LTE.",
    "Yes", "No", "20", "425 seconds", "T5571", "see HL_REQ_SIMROAM_3321", "Yes, on NR only",
    "The plan lists:\n- leave LTE at once\n- keep the record unchanged",
    "Values:\n\n| Name | Value |\n|---|---|\n| cell | 3 |",
    "Steps:\n1. Leave NR.\n2. Wait.",
    "Use this.\n```\nset cell=3\n```",
    "Sorry for the delay. The modem shall leave NR at once.",
    "The UE is unable to do so on its own. The modem shall wait for 5 seconds.",
    "I cannot stress this enough: The modem shall leave NR at once.",
    Q + " The modem shall leave NR at once and shall wait for a random time between 3 and 5 seconds.",
    "It applies for approx. 3 percent. [HL_REQ_X_1]",
]


@pytest.mark.parametrize("answer", GOOD)
def test_whole_answers(answer):
    assert P.defect(Q, answer) is None


@pytest.mark.parametrize(
    ("answer", "want"),
    [(a, "empty") for a in (None, "", " \n", "​", " ", "N/A", "none", "[]", "{}", "...", "—", "<p></p>", "``` ```", "(no answer)", "Answer:", '""')]
    + [(a, "copied") for a in (Q, Q.upper(), f'"{Q}"', f"Q: {Q}", f"You asked: {Q}", f"Question: {Q}", f"{Q} {Q}", Q.rstrip("?"))]
    + [(a, "refusal") for a in ("I'm sorry, but I can't help with that.", "No comment.", "Dazu kann ich leider keine Auskunft geben.", "回答は差し控えます。", "Не могу ответить на этот вопрос.", "As an assistant, that has to stay unanswered. Please rephrase the question.", "Sorry!", "Regarding the X: I have nothing I could tell you.")]
    + [(a, "truncated") for a in ("The modem shall stop every attempt. It shall then retu", "The modem shall leave NR (see HL_REQ_", "Do this. ```\nset cell=3\nset t", "The modem shall stop. | Name | Value |\n|---|---|\n| cell", "The modem shall wait until...", "Steps:\n1. Leave NR.\n2. Wait.\n3.", "Steps:\n1. Leave NR.\n2. Wri")]
    + [(a, "other_language") for a in ("Nur das Modem kann den Schlüssel ohne weitere Rückfrage verwerfen.", "如果网络没有响应，表中的数值158适用于所有设备。")],
)
def test_defects(answer, want):
    assert P.defect(Q, answer) == want


def test_short_question_behind_an_announcement():
    assert P.defect("What is the default of ABCDE_FGHI_JKLM?", "Question: What is the default of ABCDE_FGHI_JKLM?") == "copied"
    assert P.defect("Why?", "Question: why?") == "copied"


def test_language_asked_for():
    a = "Nur das Modem kann den Schlüssel ohne weitere Rückfrage verwerfen."
    assert P.defect(Q + " Please answer in German.", a) is None
    assert P.defect("Was soll das Modem tun, wenn der Akku leer ist?", a) is None


def test_suffix_automaton_against_brute_force():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        s, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        for least in (1, 2, 3):
            hit = [False] * len(t)
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    if t[i:j] in s:
                        hit[i:j] = [True] * (j - i)
            assert P.SuffixAutomaton(s).covered(t, least) == sum(hit), (s, t, least)


def test_operator(spark):
    df = spark.createDataFrame([(1, Q, None, "x"), (1, Q, None, "x"), (2, None, "Fine, it is done.", "x"), (3, None, None, "y"), (4, Q, "word " * 20000 + ".", "z")], "id long, question string, answer string, defect string")
    got = {r.id: r.defect for r in P.broken_pairs(df).collect()}
    assert got == {1: "empty", 3: "empty"}
    assert P.broken_pairs(df.limit(0)).count() == 0


def test_a_question_given_back_many_times_is_copied():
    assert P.copied(Q, " ".join([Q] * 12)) and P.defect(Q, " ".join([Q] * 12)) == "copied"
    assert not P.copied(Q, " ".join([Q] * 2) + " The modem shall leave NR at once and wait for three seconds." * 20)


def test_held_out_refusals():
    """Sentences written apart from the lists. First measured, before anything was mended for them: 42 of 50 refusals
    found, 2 of 50 answers taken for one."""
    from tests.llm.held_out import ANSWERED, REFUSED

    q = "What does the plan say about this case?"
    found = sum(P.defect(q, x) == "refusal" for x in REFUSED)
    wrong = sum(P.defect(q, x) == "refusal" for x in ANSWERED)
    assert found >= 0.9 * len(REFUSED) and wrong <= 0.05 * (found + wrong)


@pytest.mark.parametrize("answer", ["Follow the 3GPP guidelines.", "See the operator guidelines, section 4.", "Keep it confidential.", "No reply is sent to the network.", "Blocked by policy until the SIM registers.", "Unknown", "Undefined", "false", "string", "A"])
def test_answers_that_look_like_defects(answer):
    assert P.defect("Which parameter is it?", answer) is None


@pytest.mark.parametrize("answer", ["I will not write that for you.", "That would be a question for your network operator, I am afraid."])
def test_refusals_in_other_words(answer):
    assert P.defect(Q, answer) == "refusal"


def test_a_language_that_nobody_votes_for():
    finnish = "Laite odottaa verkon vastausta ja tallentaa profiilin muistiin ennen kuin ajastin päättyy, minkä jälkeen se lähettää uuden viestin palvelimelle."
    assert P.defect(Q, finnish) == "other_language"
    assert P.defect(Q, "<unknown>") == "empty" and P.defect(Q, "(empty)") == "empty"


def test_courtesy_has_no_length():
    assert P.defect(Q, "I can't help with that. " + "Thank you for asking, thank you, thanks, " * 6 + "thank you.") == "refusal"
