"""What is known beforehand about the twelve languages: codes, spellings, frequent words, scripts."""

from __future__ import annotations

LANGS = ["en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "zh", "ja"]

# Names of the languages as people write them (lower case), beside the two-letter code itself.
NAMES = {
    "en": "eng english englisch anglais inglés ingles inglês inglese engels engelska angielski английский 英语 英文 英語",
    "de": "deu ger german deutsch allemand alemán aleman alemão alemao tedesco duits tyska niemiecki немецкий 德语 德文 ドイツ語",
    "fr": "fra fre french französisch franzoesisch français francais francés frances francês francese frans franska francuski французский 法语 法文 フランス語",
    "es": "spa spanish spanisch espagnol español espanol castellano espanhol spagnolo spaans spanska hiszpański hiszpanski испанский 西班牙语 西班牙文 スペイン語",
    "pt": "por portuguese portugiesisch portugais portugués portugues português portoghese portugees portugisiska portugalski португальский 葡萄牙语 ポルトガル語",
    "it": "ita italian italienisch italien italiano italiaans italienska włoski wloski итальянский 意大利语 イタリア語",
    "nl": "nld dut dutch niederländisch niederlaendisch holländisch néerlandais neerlandais neerlandés holandés neerlandês holandês olandese nederlands holländska nederländska niderlandzki holenderski нидерландский голландский 荷兰语 オランダ語",
    "sv": "swe swedish schwedisch suédois suedois sueco svedese zweeds svenska szwedzki шведский 瑞典语 スウェーデン語",
    "pl": "pol polish polnisch polonais polaco polonês polones polacco pools polska polski польский 波兰语 ポーランド語",
    "ru": "rus russian russisch russe ruso russo russisch ryska rosyjski русский 俄语 俄文 ロシア語",
    "zh": "zho chi cmn chinese chinesisch chinois chino chinês chines cinese chinees kinesiska chiński chinski китайский 中文 汉语 漢語 普通话 中国語 mandarin hans hant cn",
    "ja": "jpn japanese japanisch japonais japonés japones japonês giapponese japans japanska japoński japonski японский 日语 日文 日本語 jp",
}

# Frequent function words of each language (lower case).
FREQUENT = {
    "en": "the of and to a in is that for it as was with be by on not or are this from at which but have an had they you were their one all we can her has there been if more when will would who so no what up out into than them only some could these shall should must may its other any each also under between while after before because does do how",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kann soll muss darf sollte wenn falls solange sobald danach diesem diese dieser dieses jede jeder ohne zwischen kein keine nichts hier lange alle gilt was welche welcher warum wer wo",
    "fr": "le la les de des du un une et est en que qui dans pour pas au aux par sur ce cette se plus il elle ne sont avec son sa ses ou mais comme tout on nous vous leur être fait peut doit si lorsque quand après avant sans entre tant ici aucun aucune cas quel quelle combien afin tous toutes puis ensuite ont été ces",
    "es": "el la los las de del un una y es en que no se por para con su al lo como más pero sus le ha si porque esta este son entre está cuando muy sin sobre ser tiene también me hasta hay donde quien desde todo nos todos uno les ni contra ese eso ante ellos debe puede debería luego después antes solo mientras ningún ninguna cuál qué cuántas aquí caso",
    "pt": "o a os as de do da dos das um uma e é em no na nos nas que não se por para com seu sua ao aos à às mais mas como foi ele ela entre depois sem mesmo quando muito já está eu também só pelo pela até isso deve pode deveria antes enquanto nenhum nenhuma qual quantas caso apenas então esse essa este esta ser tem são aqui",
    "it": "il lo la i gli le di del della dei delle dello un uno una e è in nel nella che non si per con su sul sulla al alla ai alle da dal dalla come più ma sono anche questo questa o se quando dopo prima senza tra fra fino deve può dovrebbe caso qui nessun nessuna quale quante cosa soltanto finché poi tutti tutte ha hanno essere loro ogni",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit door over naar hij ze wordt worden werd heeft hebben kan moet mag zou nog wel geen deze dit die daarna wanneer zolang voordat tussen zonder alle alleen hier lang wat welke hoe vaak waarom of tot onder geldt eerst moeten",
    "sv": "och i att det som en på är av för med den till inte om ett han de har var så från vid kan man när år nu bara efter eller men under också ska skulle måste får bör där här alla ingen inget denna detta dessa mellan utan innan medan vilken vilket vad hur därefter först sedan gäller finns blir hos sin sitt sina",
    "pl": "i w na z do się nie jest to że o jak po co tak za od przez dla przy oraz ale ma być może musi lub czy jeżeli jeśli gdy kiedy dopóki zanim potem następnie tylko już tego tej tym ten ta te są był była bez między wszystkie żadna żaden który która które jaki jaka ile razy ani nad pod tu wolno powinien ze",
    "ru": "и в не на что с по это как к из у за от о для при или но если когда пока после до только все так же он она они мы вы его её их был была было быть может должен должна можно нельзя этом этот эта эти здесь слишком сначала потом затем без между какой какая сколько раз ни бы то ли",
    "zh": "的 是 在 不 了 和 有 我 这 他 也 就 都 而 及 与 着 或 一个 没有 我们 如果 当 时 必须 可以 应 只有 之后 在此 情况 下 所有 不得 什么 多少 如何 为什么 最多 内 前 后",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あと よう また もの という あり まで られ なら その後 とき 場合 べき してよい ません ます です",
}

FREQUENT_SETS = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
OF_WORD: dict[str, tuple[str, ...]] = {}
for _lang in LANGS:
    for _w in FREQUENT_SETS[_lang]:
        OF_WORD[_w] = (*OF_WORD.get(_w, ()), _lang)

# Languages beyond the twelve that a label may name (code, then other codes and names, lower case).
ELSEWHERE = {
    "fi": "fin finnish suomi", "da": "dan danish dansk", "nb": "nor nob norwegian norsk", "is": "isl icelandic", "cs": "ces cze czech čeština", "sk": "slk slovak slovenčina", "hu": "hun hungarian magyar",
    "ro": "ron rum romanian română", "bg": "bul bulgarian български", "el": "ell gre greek ελληνικά", "tr": "tur turkish türkçe", "ukr": "ukrainian українська", "sr": "srp serbian српски", "hr": "hrv croatian hrvatski",
    "sl": "slv slovenian slovenščina", "et": "est estonian eesti", "lv": "lav latvian latviešu", "lt": "lit lithuanian lietuvių", "ca": "cat catalan català", "eu": "eus baq basque euskara", "gl": "glg galician galego",
    "ga": "gle irish gaeilge", "ko": "kor korean 한국어", "vi": "vie vietnamese", "th": "tha thai ไทย", "id": "ind indonesian", "ms": "msa may malay", "hi": "hin hindi हिन्दी", "ar": "ara arabic العربية", "he": "heb hebrew עברית", "fa": "fas per persian farsi فارسی",
}

NAME_OF = {n: k for k, names in NAMES.items() for n in [k, *names.split()]}
for _k, _names in ELSEWHERE.items():
    for _n in [_k, *_names.split()]:
        NAME_OF.setdefault(_n, _k)
NAME_OF["se"] = "sv"
NAME_OF.update({"gb": "en", "us": "en", "uk": "en"})
# Codes of regions and scripts, which name a language only when they stand alone.
REGIONS = ("gb", "us", "uk", "cn", "jp", "se", "hans", "hant")


def language_of_label(label: str | None) -> str | None:
    """The code of the language that a label in any spelling names, with or without a region, also one beyond LANGS; None if
    it names none."""
    if not label:
        return None
    s = label.strip().lower()
    if s in NAME_OF:
        return NAME_OF[s]
    head = s.replace("_", "-").replace("(", "-").replace(" ", "-").split("-")[0]
    if head in NAME_OF and head not in REGIONS:
        return NAME_OF[head]
    return None


def is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c >= "\U00020000"


def is_kana(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "ㇰ" <= c <= "ㇿ" or "ｦ" <= c <= "ﾟ"


def is_cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ӿ"
