"""What living languages write: the letters of each alphabet beyond ASCII, and how often Cyrillic letters come."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Letters beyond ASCII, lower case, of languages in Latin script as listed in public locale data.
LATIN = {
    "Afrikaans": "áèéêëîïôöúû", "Albanian": "çë", "Azerbaijani": "çəğıöşü", "Bambara": "ɛɔɲŋ", "Basque": "ñçü", "Bosnian, Croatian, Serbian": "čćđšž",
    "Breton": "âêîôûùüñ", "Catalan": "àçéèíïóòúü", "Crimean Tatar": "âçğıñöşü", "Czech": "áčďéěíňóřšťúůýž", "Danish, Norwegian": "æøåéèêóòôàäöüáíú",
    "Dutch": "áéíóúèëêïöüàçôûîĳ", "Esperanto": "ĉĝĥĵŝŭ", "Estonian": "äõöüšž", "Ewe": "ɖɛƒɣŋɔʋẽĩũ", "Faroese": "áðíóúýæø", "Finnish": "äöåšž",
    "French": "àâæçéèêëîïôœùûüÿ", "Frisian": "âêîôûúëïéèöü", "Fula": "ɓɗŋɲƴ", "Galician": "áéíóúüñï", "German": "äöüß", "Guarani": "áéíóúýñãẽĩõũỹ",
    "Hausa": "ɓɗƙƴ", "Hungarian": "áéíóöőúüű", "Icelandic": "áéíóúýþæðö", "Igbo": "ịọụṅàáèéìíòóùúǹḿ", "Irish": "áéíóúḃċḋḟġṁṗṡṫ", "Italian": "àèéìíîòóùú",
    "Kashubian": "ãéëńòóôùżł", "Kurdish": "çêîşû", "Latin with lengths": "āēīōūȳ", "Latvian": "āčēģīķļņšūžōŗ", "Lithuanian": "ąčęėįšųūž", "Luxembourgish": "äëéöü",
    "Maltese": "ċġħżàèìòù", "Maori, Hawaiian": "āēīōū", "Occitan": "àáçèéíïòóúü", "Polish": "ąćęłńóśźż", "Portuguese": "àáâãçéêíóôõúü", "Romanian": "ăâîșț",
    "Romanian with cedillas": "ăâîşţ", "Sami": "áčđŋšŧžâäåöø", "Scottish Gaelic": "àèìòùáéó", "Slovak": "áäčďéíĺľňóôŕšťúýž", "Slovenian": "čšžćđ", "Sorbian": "čćěłńóřŕšžź",
    "Spanish": "áéíñóúüïç", "Swedish": "åäöéàüáèë", "Turkish": "çğıöşüâîû", "Turkmen": "çäňöşüýž", "Twi": "ɛɔ", "Welsh": "âêîôûŵŷáéíóúẃýàèìòùẁỳëïö", "Wolof": "àéëóñŋ",
    "Yoruba": "ẹọṣáàéèíìóòúùńǹḿāēīōū", "Chinese in Latin letters": "āáǎàēéěèīíǐìōóǒòūúǔùüǖǘǚǜ", "Sanskrit in Latin letters": "āīūṛṝḷṃḥṅñṭḍṇśṣ", "Arabic in Latin letters": "āīūḥṣḍṭẓġšḫṯḏ",
}
_RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: Letters of languages in Cyrillic script beside or in place of the Russian ones.
CYRILLIC = {
    "Russian": "", "Ukrainian": "іїєґ", "Belarusian": "іў", "Bulgarian": "ѝѐ", "Serbian": "ђјљњћџ", "Macedonian": "ѓѕјљњќџѐѝ", "Montenegrin": "ђјљњћџс́з́", "Kazakh": "әғқңөұүһі", "Kyrgyz": "ңөү", "Mongolian": "өү",
    "Tatar": "әөүҗңһ", "Bashkir": "әөүғҡҙңһҫ", "Tajik": "ғӣқӯҳҷ", "Uzbek": "ўқғҳ", "Chuvash": "ӑӗҫӳ", "Ossetian": "ӕ", "Chechen": "ӏ", "Yakut": "ҕҥөһү", "Abkhaz": "ҕҧқҟҭҳҵҷҽҿәӡ", "Udmurt": "ӝӟӥӧӵ", "Komi": "іӧ", "Mari": "ҥӧӱӓӹ",
}
#: Russian letters from the most to the least frequent, and their public shares in per mille.
_CYRILLIC_ORDER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_CYRILLIC_SHARES = (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)


def _vietnamese() -> str:
    """Vowels with each quality and tone mark, by rule."""
    vowels = [unicodedata.normalize("NFC", v + q) for v, qs in (("a", ("", "̆", "̂")), ("e", ("", "̂")), ("i", ("",)), ("o", ("", "̂", "̛")), ("u", ("", "̛")), ("y", ("",))) for q in qs]
    return "đ" + "".join(unicodedata.normalize("NFC", v + t) for v in vowels for t in ("", "̀", "́", "̃", "̉", "̣"))


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or o in (0x253, 0x254, 0x256, 0x257, 0x259, 0x25B, 0x263, 0x272, 0x28B):
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    return "other"


@lru_cache(1)
def alphabets() -> dict[str, tuple[frozenset[str], ...]]:
    """Per script the sets of letters beyond ASCII that are written together."""
    greek = frozenset(chr(o) for o in (*range(0x370, 0x400), *range(0x1F00, 0x2000)) if chr(o).isalpha())
    return {
        "latin": tuple(frozenset(x) for x in (*LATIN.values(), _vietnamese())),
        "cyrillic": tuple(frozenset(_RUSSIAN + x) for x in CYRILLIC.values()),
        "greek": (greek,),
    }


@lru_cache(50_000)
def strangers(letters: frozenset[str], kind: str) -> int:
    """How many of these lower-case letters beyond ASCII are missing from the alphabet that suits them best."""
    if not letters:
        return 0
    sets = alphabets().get(kind)
    return 0 if sets is None else min(len(letters - known) for known in sets)


@lru_cache(1)
def cyrillic_surprise() -> dict[str, float]:
    """Bits by which a Cyrillic letter is rarer than letters are on average; other letters of the script count as rare."""
    from math import log2

    total = sum(_CYRILLIC_SHARES)
    return {c: log2(total / s) - 4.7 for c, s in zip(_CYRILLIC_ORDER, _CYRILLIC_SHARES)}
