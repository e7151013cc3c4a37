"""Character classes for regular expressions (inside brackets) and tables of fixed values.

The classes follow Unicode text rules: white space includes no-break and typographic
spaces, word characters are letters, numbers and the underscore.
"""

WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters, as text.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters with letter-like and other numbers; letters and all numbers.
LETTER = r"\p{L}\p{Nl}\p{No}"
ALNUM = r"\p{L}\p{N}"
#: Decimal digits and the digits among other numbers (superscripts, circled and the like).
DIGIT = (
    r"\p{Nd}\xB2\xB3\xB9\u1369-\u1371\u19DA\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247C\u2488-\u2490"
    r"\u24EA\u24F5-\u24FD\u24FF\u2776-\u277E\u2780-\u2788\u278A-\u2792\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
CJK = r"\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF"

# Scripts that are counted, as ranges.
SCRIPTS = {
    "latin": r"A-Za-z",
    "cyrillic": r"\u0400-\u04FF",
    "cjk": CJK,
    "arabic": r"\u0600-\u06FF\u0750-\u077F",
    "greek": r"\u0370-\u03FF",
    "hebrew": r"\u0590-\u05FF",
    "thai": r"\u0E00-\u0E7F",
    "devanagari": r"\u0900-\u097F",
}
# Languages not written in Latin script.
SCRIPT_OF_LANGUAGE = {
    "ru": "cyrillic", "uk": "cyrillic", "be": "cyrillic", "bg": "cyrillic", "mk": "cyrillic", "sr": "cyrillic",
    "kk": "cyrillic", "ky": "cyrillic", "tg": "cyrillic", "tt": "cyrillic", "mn": "cyrillic",
    "zh": "cjk", "ja": "cjk", "ko": "cjk",
    "el": "greek",
    "ar": "arabic", "fa": "arabic", "ur": "arabic", "ps": "arabic", "sd": "arabic",
    "he": "hebrew", "iw": "hebrew", "yi": "hebrew",
    "th": "thai",
    "hi": "devanagari", "mr": "devanagari", "ne": "devanagari", "sa": "devanagari",
}
# Abbreviations after which a sentence goes on, in English, German and Russian.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "f.a.q.", "a.m.", "p.m.",
    "u.s.", "u.k.", "ph.d.", "vol.", "fig.", "approx.", "incl.",
    "z.b.", "d.h.", "u.a.", "usw.", "bzw.", "ggf.", "vgl.", "evtl.", "u.s.w.",
    "г.", "ул.", "т.е.", "т.д.", "т.п.", "т.к.", "напр.", "рис.", "табл.", "см.", "гг.",
)
# Forms of service markup. A percent token; a caret token; a variant, of which the first form stays;
# a colour tag with its brackets escaped once or twice, and one as it is; a tag that was written as text.
PERCENT_TOKEN = r"%[A-Za-z_][A-Za-z0-9_.\-]{0,80}%+"
CARET_TOKEN = r"\^\{[^{}\n]{1,80}\}\^"
VARIANT = r"(?i)\$m\(([^|()]*)\|[^()]*\)"
ESCAPED_COLOUR = r"(?i)&(?:amp;)?lt;\s*/?\s*color(?:\s*=[^&<>]{0,120})?\s*&(?:amp;)?gt;"
BARE_COLOUR = r"(?i)<\s*/?\s*color(?:\s*=[^<>]{0,120})?\s*>"
WRITTEN_TAG = r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s+[^<>]{0,200})?\s*/?>"
# What a link looks like once the marks round it are off.
LINK_MARKS = ".,;:!?()[]{}<>\"'"
URL_START = ("http://", "https://", "www.")
# Marks that end a sentence, marks that may close it, letters that may begin the next without a space.
STOPS, CLOSERS, CAPITALS = ".!?…", "\"'”»)]", "A-ZА-ЯЁ"
# Where a removed tag or a joint of two parts leaves no space, or forces one.
TIGHT_AFTER, TIGHT_BEFORE = "([{\"'", ",.;:!?)]}\"'"
SPACE_AFTER = ".!?:;)]}…"
JOINT_AFTER, JOINT_BEFORE = "([{«", ".,!?:;)]}»"


def either(characters: str) -> str:
    """A class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "[]{}()^-.?!:;,\"'" else c for c in characters) + "]"
