"""Broken prompt and response pairs.

Each pair is looked at by four devices, in this order, and gets the first defect found:

* ``empty`` - nothing is left of the answer after stand-ins and empty brackets, fences and tags are taken away;
* ``copied`` - a suffix automaton of the prompt is traversed with the answer; what its long matches cover is copied. A
  pair is defective when hardly anything else is left, apart from phrases that announce a quotation;
* ``refusal`` - Aho-Corasick automata of refusal phrases find sentences that decline: whole phrases, or phrases that do so
  only where the writer or the answering is what they are about, or the slots of writer, inability and telling; a pair is
  defective when the other sentences are courtesies only;
* ``truncated`` - a stack of delimiters ends with one open, or the last line of running text has no end of sentence;
* ``other_language`` - stopwords and scripts vote for a language of prompt and answer, and the votes differ clearly,
  unless the prompt names the answer's language; an answer of running text without any frequent word of the prompt's
  language is in another one even where nobody votes for that.

Defined results: a null answer is ``empty``; a null question cannot be copied and has no language. Repeated deliveries
(same id) give one row. Texts are processed whole; the work is linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.llm.languages import LANGS, NAMES, OF_WORD, is_han, is_kana
from reqloom.sources.tables import table

# Stand-ins for an answer (compared after lower case and without outer punctuation).
STAND_INS = frozenset(
    [
        "none", "null", "nil", "nan", "n/a", "na", "n.a", "not applicable", "no answer", "no response", "no reply", "no content", "no output", "no data", "no text", "not available", "not answered",
        "unanswered", "tbd", "tba", "tbc", "todo", "to do", "to be done", "to be defined", "placeholder", "answer", "lorem ipsum", "xxx", "here is the answer", "the answer is", "my answer",
        "your answer here", "insert answer here", "see answer", "antwort", "keine antwort", "réponse", "pas de réponse", "sans réponse", "respuesta", "sin respuesta", "resposta", "sem resposta",
        "risposta", "nessuna risposta", "antwoord", "geen antwoord", "svar", "inget svar", "odpowiedź", "brak odpowiedzi", "brak", "ответ", "нет ответа", "无", "无回答", "没有回答", "答案", "回答", "なし", "回答なし", "答え",
    ]
)
# Words that may be a value as well; they stand in for an answer only in brackets, as in `<empty>`.
BRACKETED = frozenset(
    [
        "empty", "blank", "pending", "undefined", "unknown", "missing", "void", "nothing", "response", "reply", "output", "result", "text", "xx", "x", "string", "error", "assistant", "ai", "bot",
        "leer", "vide", "vacío", "vazio", "vuoto", "leeg", "tomt", "пусто", "空",
    ]
)

# Phrases that decline or say that one is unable to answer (lower case; apostrophes made straight).
REFUSALS = """
i can't help|i cannot help|can't help with|cannot help with|can not help with|can't assist|cannot assist|unable to assist|unable to help|unable to answer|unable to provide|unable to respond|unable to comment
not able to answer|not able to say|not able to help|not able to provide|not able to assist|not able to respond|not able to tell|can't answer|cannot answer|can not answer|couldn't answer|could not answer|won't answer|will not answer|can't provide|cannot provide|won't provide|will not provide
won't be able to|will not be able to|can't say|cannot say|can't tell|cannot tell|can't comment|cannot comment|can't respond|cannot respond|can't discuss|cannot discuss|can't share|cannot share|can't do that|cannot do that|can't comply|cannot comply|cannot fulfil|can't fulfil|can't give|cannot give|can't speak|cannot speak
rather not|prefer not|must decline|have to decline|i decline|i refuse|must refuse|have to refuse|refuse to answer|respectfully decline|request declined|request refused|no comment|i pass on|i'll pass|i do not know|i don't know|don't know the answer|i have no answer|i have nothing
outside of what i|outside what i|beyond what i|beyond my|outside my|out of my|out of scope for me|not in a position
look elsewhere|no answer can be|no answer is possible|no answer from|there is no answer from|stay unanswered|remain unanswered|goes unanswered|leave this unanswered|leave it unanswered|impossible for me to|have no access|don't have access|do not have access|lack access
lack the information|don't have the information|do not have the information|don't have that information|don't have enough|do not have enough|as an ai|as a language model|will not go into|won't go into|not going to answer|against my
i may not|||not for me to|not my place|cannot be answered by me|can't be answered by me|is not something i|ask someone else|ask somebody else|someone else will have to|i must leave|i will have to leave|i'd rather|i would rather|not at liberty|disclosed by me|answered by me|not my call
kann ich nicht|kann ich leider|kann dir nicht|kann ihnen nicht|kann dazu nicht|ich kann diese|ich kann darauf|nicht befugt|darf ich keine|ich kann das nicht|nicht beantworten|keine auskunft|keine antwort geben|keine antwort möglich|darf ich nicht|darf dazu|darf darüber|möchte ich nicht|möchte mich dazu nicht|will ich nicht|nicht in der lage|bin außerstande|lehne ich ab|muss ich ablehnen|nicht weiterhelfen|nicht helfen|leider nicht möglich|ist mir nicht möglich|dazu sage ich nichts|weiß ich nicht|ich weiß es nicht|kein kommentar
je ne peux pas|je ne puis|je ne suis pas en mesure|pas en mesure|ne suis malheureusement pas|préfère ne pas|je refuse|dois refuser|dois décliner|impossible de répondre|impossible de vous aider|impossible pour moi|m'est impossible|pas autorisé à|pas le droit de|aucune réponse à donner|je ne sais pas|sans commentaire|pas de commentaire|ne saurais répondre|ne souhaite pas|ne veux pas répondre|m'abstiens
no puedo|no me es posible|me es imposible|no soy capaz|no estoy en condiciones|no estoy autorizado|prefiero no|no tengo permitido|no me está permitido|debo rechazar|tengo que rechazar|me niego|no sé responder|no lo sé|no sé la|sin comentarios|no quiero responder|no deseo responder|me abstengo|no quisiera|no podré|imposible responder|imposible contestar
não posso|não me é possível|é-me impossível|não consigo|não sou capaz|não estou em condições|não estou autorizad|prefiro não|não me é permitido|tenho de recusar|devo recusar|recuso-me|não sei|sem comentários|não quero responder|não desejo responder|abstenho-me|não poderei|impossível responder|não gostaria de
non posso|non mi è possibile|mi è impossibile|non sono in grado|non sono autorizzat|preferisco non|non mi è permesso|non mi è consentito|devo rifiutare|devo declinare|mi rifiuto|non so rispondere|non lo so|non so la|no comment|nessun commento|non voglio rispondere|non desidero|mi astengo|non potrò|impossibile rispondere|non vorrei
ik kan niet|kan ik niet|kan ik geen|kan ik helaas|kan ik je|kan ik u|ik kan u niet|ik kan je niet|ben niet in staat|niet in staat om|liever geen|liever niet|mag ik niet|mag hier niets|kan ik niets|mag ik niets|ik mag niet|moet ik weigeren|ik weiger|wil ik niet|weet ik niet|ik weet het niet|geen commentaar|niet mogelijk om te antwoorden|is mij niet toegestaan|onthoud ik mij
jag kan inte|kan jag inte|kan jag tyvärr|jag kan tyvärr|avstår från|avstår jag|vill inte svara|vill inte kommentera|kan inte kommentera|vill jag inte|får jag inte|jag får inte|måste avböja|måste neka|jag vägrar|inte i stånd|har inte möjlighet|inte möjligt för mig|vet inte|inga kommentarer|ingen kommentar|hellre inte|helst inte
nie mogę|nie jestem w stanie|nie potrafię|wolę nie|wolałbym nie|wolałabym nie|nie wolno mi|nie mam prawa|nie mam uprawnień|muszę odmówić|odmawiam|nie wiem|bez komentarza|nie chcę|nie będę mógł|nie będę mogła|nie udzielę|niemożliwe jest udzielenie|powstrzymam się
не могу|не смогу|не в состоянии|не в силах|предпочту не|предпочитаю не|не хочу|не буду отвечать|не имею права|мне не разрешено|мне нельзя|вынужден отказать|вынуждена отказать|отказываюсь|я не знаю|без комментариев|воздержусь|невозможно ответить|не вправе|не уполномочен
无法回答|无法答复|无法提供|无法协助|无法帮助|不能回答|不能协助|不能提供|不能帮助|不便作答|不便回答|不便透露|不能透露|不便评论|恕不|恕我|拒绝回答|不予回答|不予置评|无可奉告|我不知道|不方便回答|不方便透露|没有办法回答|不想回答|帮不了|不会回答|无权回答|不回答|无法作答|无法处理
お答えできません|お答えできかね|お答えいたしかね|お答えしかね|答えられません|答えることはできません|答えることができません|回答できません|回答できかね|回答いたしかね|回答しかね|回答は控え|回答は差し控え|回答を控え|回答を差し控え|差し控え|対応できません|対応いたしかね|対応しかね|対応できかね|お手伝いできません|お手伝いできかね|お手伝いいたしかね|分かりません|わかりません|お断り|ご遠慮|申し上げられません|お話しできません|お教えできません|提供できません|ノーコメント|応じられません|応じかね
""".strip()

# What declines only when the writer or the answering is what it is about.
WEAK = """
not allowed to|not permitted to|not authorized|not authorised|guidelines|blocked here|blocked by policy|by policy|against policy|no reply|be disclosed|be revealed|not disclose|not reveal|no permission to|lack permission|confidential|no idea|not going to|decline to
enough information to|sufficient information to|enough context to|without access|access that was not|keep silent|remain silent|stay silent|do not allow|does not allow|not allow me|no information on|no information about|possible for me to|not something i|lets me answer|let me answer|allows me to answer
""".strip()
_SELF = re.compile(r"\b(?:i|i'm|i'd|i'll|i've|me|my|mine|we|we're|us|our)\b", re.I)
_ANSWERING = re.compile(r"\banswer(?:s|ed|ing)?\b|\bunanswered\b|\b(?:this|that|the|your) (?:question|request|matter|topic)\b|\brespond(?:ing)?\b|\bcomment(?:ing)?\b", re.I)
# The three slots of an English refusal in the first person: writer, inability or unwillingness, telling.
_SLOTS = re.compile(
    r"\b(?:i|we)(?:'m| am|'re| are)? ?(?:really |simply |just |afraid |sorry,? |but |do |also |still )*"
    r"(?:can't|can not|cannot|could not|couldn't|won't|will not|would not|wouldn't|must not|may not|shall not|don't|do not|am not going to|(?:not )?(?:able|allowed|willing|permitted|prepared) to|unable to|refuse to|decline to|(?:would|'d) rather not|prefer not to)\b"
    r"[^.!?]*?\b(?:help|assist|answer|say|tell|comment|respond|reply|provide|discuss(?:ing)?|share|disclose|reveal|speak|talk|explain|write|comply|fulfil|fulfill|advise|confirm|elaborate|know|go into|feel (?:comfortable|free|able)|do (?:that|this|it)|give (?:you|an|any|that|this))\b",
    re.I,
)
# The question is passed on to somebody else.
_PASSED_ON = re.compile(r"^\W*request (?:declined|denied|refused)\W*$|\b(?:question|matter|one|something|topic) (?:for|to be asked of) (?:your|the|somebody|someone|another)\b|\b(?:better|best) (?:asked|put|addressed)\b|\b(?:ask|consult|turn to) (?:your|somebody|someone|an expert|another)\b", re.I)

# What may stand beside a refusal or a quoted question without being an answer.
COURTESIES = """
sorry|i'm sorry|i am sorry|apologies|my apologies|unfortunately|thanks|thank you|thanks for asking|hmm|well|as an assistant|please|try asking|please rephrase|please contact|contact the|is there anything else|anything else|let me know|feel free|hope this helps|good question|great question|have a nice day|ask me something else|something else|ask again|ok|okay|hello|hi
leider|es tut mir leid|tut mir leid|entschuldigung|bitte|danke|désolé|malheureusement|merci|je regrette|lo siento|lamentablemente|por desgracia|gracias|por favor|desculpe|peço desculpa|lamento|infelizmente|obrigado|mi dispiace|purtroppo|spiacente|grazie|per favore|het spijt me|sorry|helaas|bedankt|alstublieft|tyvärr|jag är ledsen|förlåt|tack|przepraszam|przykro mi|niestety|dziękuję|proszę|извините|к сожалению|простите|спасибо|пожалуйста|抱歉|很抱歉|对不起|谢谢|请|申し訳ありません|申し訳ございません|すみません|恐れ入りますが|残念ながら
""".strip()

# A line that announces the quotation of a question.
ANNOUNCE = re.compile(r"^\W*(?:q|question|you asked|your question(?: was| is)?|you wrote|user|prompt|asked|the question (?:is|was)|frage|ihre frage|pregunta|pergunta|domanda|vraag|fråga|pytanie|вопрос|问题|問題|質問|問)(?![^\W_])\W*", re.I)

# Words after which a sentence or an item cannot end.
OPEN_WORDS = frozenset(
    "the a an of to in on at by for with from and or but if when while unless until shall should must may can is are was be this that these those as than into over under within after before during between without its their "
    "der die das den dem des ein eine und oder wenn falls von zu im am mit für bei nach vor muss soll darf le la les un une des du de et ou si à au aux pour dans sur el los las del y o con por para en que il lo gli i di e nel della "
    "het een van en of als op te voor met och att i på av om som w z do na od oraz lub i że и в на с по для или если что".split()
)

_END = re.compile(r"[.!?。！？:：][\"'”’»)\]】」』*_`]*$|[)\]】」』>|`}]$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+|(?<=:)\s+")
_BARE = re.compile(r"^\W*$")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0002ffff]")
_RUNNING = re.compile(r"[^\W\d_]+ [^\W\d_]+ [^\W\d_]+[^.!?]*[.!?]")
_KANA = re.compile(r"[\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f]")
_CYR = re.compile(r"[\u0400-\u04ff]")
_ITEM = re.compile(r"^\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【", "”": "“", "»": "«"}
_OPENERS = set(_PAIRS.values())


class SuffixAutomaton:
    """All substrings of a text as paths; built in linear time."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, text: str, least: int, spare: float = float("inf")) -> int:
        """Characters of `text` that lie in matches of at least `least` characters; the traversal ends as soon as more
        than `spare` of them lie in none, which later ones cannot change."""
        state = length = 0
        total, upto = 0, 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length >= least:
                total += i - max(upto, i - length)
                upto = i
            elif i - length - total > spare:
                break
        return total


def fold(s: str) -> str:
    """Lower case, no punctuation, single blanks."""
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


_TAGS = re.compile(r"<[^<>]{0,40}>|&nbsp;|[\u200b\u200c\u200d\u2060\ufeff]")
_MARKS = re.compile(r"[\"'`*_~()\[\]{}<>«»“”„=#|,;:.!?…。、：\-–—/\\]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_IN_BRACKETS = re.compile(r"^\W*[(\[{<].*[)\]}>]\W*$", re.S)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = _TAGS.sub(" ", answer)
    folded = " ".join(_MARKS.sub(" ", s).split()).lower()
    if not folded:
        if not re.search(r"[^\W_]", s):
            # a tag may be the stand-in itself, or one around nothing
            return True
        return False
    if folded in STAND_INS or _OUTER.sub("", s.lower()) in STAND_INS:
        return True
    return folded in BRACKETED and _IN_BRACKETS.match(s) is not None


def copied(question: str | None, answer: str) -> bool:
    if not question:
        return False
    q = fold(question)
    a = fold(ANNOUNCE.sub("", answer, count=1))
    if not a or len(q) < 3:
        return bool(a) and a == q
    least = max(3, min(10, len(q) // 3))
    got = SuffixAutomaton(q).covered(a, least, 0.15 * len(a))
    return got >= 0.85 * len(a) and got >= 0.5 * len(q)


_automata: dict = {}


def _automaton(name: str, text: str):
    if name not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in {p for line in text.split("\n") for p in line.split("|") if p}:
            a.add_word(p, len(p))
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


# Subjects of statements about a device or person, which decline nothing on the writer's part.
_THIRD = re.compile(r"^\W*(?:the|a|an|this|that|it|its|any|each|der|das|die|il|el|le|la|o)\s+(?!question|answer|answering)", re.I)
# A device or network as the subject of a Chinese or Japanese sentence.
_THING = re.compile(r"^\W*(?:[^，,。]{0,12}?(?:设备|终端|网络|用户|应用|服务器|模块|系统|固件|代理|订阅者?|定时器|计数器)[^我，,。]{0,8}(?:无法|不能|不得|不会)|[^、。]{0,16}?(?:端末|ネットワーク|機器|装置|モデム|サーバー?|アプリ|利用者|加入者|ファームウェア|エージェント|タイマー)(?:は|が|では))")
_FIRST = re.compile(r"\b(?:i|i'm|i'd|i'll|i've|me|my|we|us|our|ich|mir|mich|je|moi|yo|eu|io|mi|ik|mij|jag|mig|wir|nous|wij)\b|\bno answer\b|\banswer(?:ing|ed)?\b|\bunanswered\b", re.I)


def refuses(sentence: str) -> bool:
    """Whether a sentence declines: a whole phrase of refusal, or the slots of one: who (the writer), inability, telling."""
    s = sentence.lower().replace("’", "'").replace("‘", "'")
    weak = next(_automaton("weak", WEAK).iter(s), None) is not None
    if weak and (_SELF.search(s) or _ANSWERING.search(s)):
        return True
    if _SLOTS.search(s) or (_PASSED_ON.search(s) and not re.search(r"\d", s)):
        return True
    if next(_automaton("refusal", REFUSALS).iter(s), None) is None:
        return False
    if s.isascii() and _THIRD.match(s) and not _FIRST.search(s):
        return False
    return not _THING.match(s)


_IDIOM = re.compile(r"\bcannot stress|\bcan't stress|\bcannot be overstated|\bsorry for the (?:delay|wait|late)", re.I)


def courtesy(sentence: str) -> bool:
    """Whether courtesies make up at least three tenths of a sentence."""
    s = sentence.lower().replace("’", "'")
    got = upto = 0
    for end, n in _automaton("courtesy", COURTESIES).iter(s):
        got += end + 1 - max(upto, end + 1 - n)
        upto = end + 1
    return got >= 0.3 * len(s)


def refusal(answer: str) -> bool:
    """Some sentence declines and the rest is courtesy."""
    declined, other = False, 0
    for s in _SENTENCE.split(answer):
        s = s.strip() if s else ""
        if not s or not re.search(r"[^\W_]", s):
            continue
        idiom = _IDIOM.search(s)
        if not idiom and refuses(s):
            declined = True
            continue
        if s.endswith((":", "：")):
            continue  # it only leads up to what follows
        if not re.search(r"\d", s) and courtesy(s):
            other += bool(idiom and len(fold(answer)) > len(fold(s)) + 3)
            continue
        wide = len(_WIDE.findall(s))
        other += len(_WORD.findall(_WIDE.sub(" ", s))) + wide / 2 > 2
    if declined:
        return other == 0
    return other == 0 and fold(answer) in SORRY


# An excuse that is the whole answer.
SORRY = frozenset(
    [
        "sorry", "i am sorry", "i m sorry", "apologies", "my apologies", "unfortunately not possible", "desculpe", "lo siento", "désolé", "leider nein", "leider nicht", "抱歉", "很抱歉", "对不起", "申し訳ありません", "すみません",
        "извините", "к сожалению", "tyvärr", "helaas", "niestety", "przepraszam", "purtroppo", "mi dispiace", "infelizmente", "het spijt me", "förlåt",
    ]
)


def truncated(answer: str) -> bool:
    s = answer.rstrip()
    if re.search(r"(?:\.\.\.|…)[\"'”)]*$", s) and len(s) > 5:
        return True
    if s.count("```") % 2:
        return True
    text = re.sub(r"```.*?```", " ", s, flags=re.S)
    stack: list[str] = []
    for c in text:
        if c in _OPENERS:
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    if stack:
        return True
    lines = [x for x in s.split("\n") if x.strip()]
    last = lines[-1].strip()
    if len(lines) > 1 and re.fullmatch(r"[-*•–+]|\(?\d{1,3}[.)]|\(?[a-z][.)]", last):
        return True  # the mark of an item that never came
    if last.startswith("|"):
        rows = [x.strip() for x in lines if x.strip().startswith("|")]
        return not last.endswith("|") or len({r.count("|") for r in rows[:1] + rows[-1:]}) > 1
    if _END.search(last) and not last.endswith((":", "：")):
        return False
    if last.endswith((":", "：", ",", "，", "、", ";", "；", "-", "–", "(")):
        return True
    words = re.findall(r"[^\W_]+", last)
    if words and words[-1].lower() in OPEN_WORDS and not words[-1].isupper():
        return len(words) > 1
    if _ITEM.match(lines[-1]) and len(lines) > 1:
        before = [x.strip() for x in lines[:-1] if _ITEM.match(x)]
        return bool(before) and all(x[-1] in ".;。；!?" for x in before)
    cjk = sum(is_han(c) or is_kana(c) for c in last)
    if cjk > 6:
        return True
    # running text: a whole sentence earlier in the answer, or too long for a bare value
    earlier = re.search(r"[.!?。！？](?:\s|$)", answer.replace("e.g. ", "").replace("cf. ", "")) is not None
    if re.match(r"^[\w./:#-]+$", last) and not earlier:
        return False
    return earlier or len(words) >= 6


def votes(text: str) -> tuple[dict[str, float], float]:
    """Votes of scripts and stopwords for each language, and how many words had a say."""
    v = dict.fromkeys(LANGS, 0.0)
    kana, cyr = len(_KANA.findall(text)), len(_CYR.findall(text))
    han = len(_WIDE.findall(text)) - kana
    if kana >= 2 and kana * 8 > han:
        v["ja"] += (han + kana) / 2
    else:
        v["zh"] += han / 1.5
    v["ru"] += cyr / 4
    n = (han + kana) / 2 + cyr / 4
    for w in _WORD.findall(text):
        if w[0] > "ʯ":
            continue
        langs = OF_WORD.get(w.lower())
        if langs:
            n += 1
            for x in langs:
                v[x] += 1 / len(langs)
    return v, n


_NAMED = {k: re.compile(r"(?<!\w)(?:" + "|".join(sorted((re.escape(x) for x in n.split() if len(x) > 3 or not x.isascii()), key=len, reverse=True)) + r")(?!\w)" if k not in ("zh", "ja") else "|".join(sorted((re.escape(x) for x in n.split() if len(x) > 4 or not x.isascii()), key=len, reverse=True)), re.I) for k, n in NAMES.items()}
# Declined forms that name the language of an answer.
_DECLINED = {"de": "auf deutsch|по-немецки|po niemiecku|på tyska", "en": "auf englisch|по-английски|po angielsku|på engelska", "fr": "auf französisch|по-французски|po francusku|på franska", "es": "auf spanisch|по-испански|po hiszpańsku|på spanska", "it": "по-итальянски|po włosku|på italienska", "pt": "по-португальски|po portugalsku|på portugisiska", "nl": "по-нидерландски|по-голландски|po niderlandzku|po holendersku|på nederländska|på holländska", "sv": "по-шведски|po szwedzku|på svenska", "pl": "по-польски|po polsku|på polska", "ru": "по-русски|po rosyjsku|på ryska", "zh": "по-китайски|po chińsku|på kinesiska", "ja": "по-японски|po japońsku|på japanska"}


def asks_for(question: str, lang: str) -> bool:
    return _NAMED[lang].search(question) is not None or re.search(_DECLINED[lang], question, re.I) is not None


def language(text: str, least: float) -> str | None:
    v, n = votes(text)
    best, second = sorted(v.items(), key=lambda x: -x[1])[:2]
    return best[0] if best[1] >= least and best[1] > 1.25 * second[1] else None


def foreign(text: str, lang: str) -> bool:
    """Whether running text has none of the frequent words of a language: it is in one that nobody votes for."""
    if lang in ("zh", "ja"):
        return False
    words = {w for w in _WORD.findall(text) if w.islower()}
    # of a dozen different words of running text in any of the languages at least one is a frequent one, but for one text in 10^3
    return len(words) >= 12 and _RUNNING.search(text) is not None and not any(lang in OF_WORD.get(w, ()) for w in words) and not asked_list(text)


def asked_list(text: str) -> bool:
    return any(_ITEM.match(x) or "|" in x for x in text.split("\n"))


def other_language(question: str | None, answer: str) -> bool:
    if not question:
        return False
    plain = re.sub(r"[A-Z]+_[A-Z_]+[0-9]*|```.*?```", " ", answer, flags=re.S)
    a = language(plain, 2.0)
    v, n = votes(question)
    q = max(v, key=v.get)
    if a is None:
        return v[q] >= 1.0 and foreign(plain, q)
    if v[q] < 1.0 or q == a or v[a] >= 0.8 * v[q]:
        return False
    return not asks_for(question, a)


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of one pair, or None."""
    if is_empty(answer):
        return "empty"
    if copied(question, answer):
        return "copied"
    if refusal(answer):
        return "refusal"
    # the question given back and cut is neither; running text that stops is cut
    if truncated(answer):
        return "truncated"
    if other_language(question, answer):
        return "other_language"
    return None


@F.pandas_udf(T.StringType())
def defect_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for q, a in batches:
        yield pd.Series([defect(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(q, a, strict=True)], dtype=object)


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """id, question, answer -> id, defect of every defective pair, each id once."""
    d = pairs.select("id", defect_column.asNondeterministic()("question", "answer").alias("defect"))
    return d.where(F.col("defect").isNotNull()).groupBy("id").agg(F.min("defect").alias("defect"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return broken_pairs(table(spark, base, "test_feedback"))
