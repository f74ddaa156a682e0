"""Generators of high recall for personal details in free text, and the features of what they propose.

Texts are searched in a normal form that keeps a place in the original for each character: wide digits and signs are made plain,
unusual spaces become spaces, invisible characters go, and letters are composed.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import regex

KINDS = ("name", "email", "phone", "id_number", "address")

_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(map(ord, "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"), " ") | dict.fromkeys(range(0x2010, 0x2016), "-") | {0x2212: "-", 0x2019: "'", 0xFE6B: "@"}
_UNUSUAL = re.compile("[\uff01-\uff5e\u00a0\u2000-\u200a\u202f\u205f\u3000\u2010-\u2015\u2212\u2019\ufe6b]")
_CLUSTER = regex.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]|[\u1100-\u11ff]+|\\P{M}\\p{M}+|[\u212a\u212b\u2126\u0340-\u0344\u0374\u037e\u0387]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The normal form, and for each of its characters and its end the place in `text`; None where places are the same."""
    if text.isascii():
        return text, None
    out = text.translate(_PLAIN) if _UNUSUAL.search(text) else text
    if not _INVISIBLE.search(out) and unicodedata.is_normalized("NFC", out):
        return out, None
    chars, places, at = [], [], 0
    for m in _CLUSTER.finditer(out):  # all else stands for itself
        chars.append(out[at : m.start()])
        places.extend(range(at, m.start()))
        made = "" if _INVISIBLE.match(m.group()) else unicodedata.normalize("NFC", m.group())
        chars.append(made)
        places.extend([m.start()] * len(made))
        at = m.end()
    chars.append(out[at:])
    return "".join(chars), [*places, *range(at, len(out)), len(text)]


# Words that announce or rule out a kind, in the languages of the corpus; all in lower case.
LABELS = {
    "name": "name|full name|nom|nombre|nome|vorname|nachname|artist|ownername|owner|by-line|byline|creator|photographer|fotograf|photographe|fotógrafo|subject|cc|contact",
    "phone": "phone|tel|telephone|telefon|téléphone|teléfono|tél|mobile|mobil|móvil|cell|fax|handy|portable|ph|call|ring|text|appelez|appelez le|llama|llama al|llame al|unter|bitte unter|anrufen|rufnummer|creatorworktelephone|citelwork|m|t|p|☎|📞",
    "email": "e-mail|email|mail|courriel|correo|e|contact|mailto",
    "id_number": "id|id no|id card|national id|identity card|identity|passport|passport no|passport number|ssn|social security|social insurance number|insurance number|national insurance|nino|driver's licence|driver's license|driving licence|driving license|licence|license|dl|ausweis|ausweis-nr|ausweisnummer|personalausweis|reisepass|reisepass nr|pass-nr|führerschein|führerscheinnummer|sozialversicherungsnummer|versicherungsnummer|rentenversicherungsnummer|svnr|sv-nr|pièce n°|pièce d'identité|carte d'identité|cni|passeport|passeport n°|n° de sécurité sociale|sécurité sociale|permis|permis de conduire|permis n°|nir|documento|dni|nie|nif|pasaporte|carné de conducir|permiso de conducir|n.º de la seguridad social|seguridad social|tarjeta de identidad",
    "address": "address|shoot address|adresse|anschrift|dirección|domicilio|lives at|ship to|prints go to|frames at|lieferung an|treffpunkt ist|wohnt in|wohnhaft|rendez-vous au|livrer au|livrer à|habite au|habite|enviar a|vive en|direccion|at",
}
NOT_PHONE = "order|order no|serial|number|frame|index|batch|build|size|size=|mtime|copied|count|coordinates|on|of|until|from|by|hash|vom|am|du|le|del|el|bytes|version|iso|box|card|id|ssn|passport|licence|führerschein|ausweis"
NAME_AFTER = r"prize|award|bridge|foundation|trust|street|st|road|rd|lane|avenue|ave|drive|dr|row|close|terrace|hall|square|park|museum|gallery|archive|library|school|institute|memorial|medal|trophy|cup|centre|center|theatre|theater|hospital|university|college|gmbh|ag|kg|ltd|llc|inc|co|sons|studio|studios|photography|fund|grant|society|collection|preis|stiftung|brücke|straße|platz|allee|haus|prix|fondation|pont|rue|place|musée|premio|fundación|puente|calle|plaza|museo|house|church|festival|exhibition|album|pocket|ii|iii"
NAME_BEFORE = r"prize|prix|premio|pont|puente|fondation|fundación|studio|atelier|galerie|gallery|museum|musée|museo|rue|calle|plaza|place|avenue|bildredaktion|redaktion|agentur|agence|agencia|estudio|camera|kamera|album|l'album|ordner|folder|preis|stiftung|brücke"
PLACE_BEFORE = r"in|at|near|over|bei|nach|aus|über|à|en|vers|desde|hacia"
TITLES = r"mr|mrs|ms|mx|miss|dr|prof|sir|dame|herr|frau|hr|fr|monsieur|madame|mme|mlle|m|señor|señora|sr|sra|srta|don|doña|signor|signora|dott|ing"
CUES = r"signed|signed by|photo|photo by|photos by|foto|foto de|fotos|crédit|credit|left|left is|right|right is|is|was|named|called|heißt|according to|met|ask|erteilt von|signée par|firmada por|links|rechts|izquierda|derecha|gauche|droite|retrato de|portrait of|porträt von|portrait de|thanks to|merci à|danke an|gracias a|von|par|por|by|from|to|subject|cc|with|avec|mit|con|and|und|et|y|regards|cheers|best|grüße|cordialement|saludos|hi|dear|hallo|bonjour|hola|bei|chez|für|for|pour|para|©|© \d{4}|\(c\) \d{4}|copyright|copyright \d{4}"
# Common given names, which tell more than other words but are asked of no candidate; names met in the corpus are added.
GIVEN = set(
    "adam agnès aisha alan alba alejandro alex alexander alice amina amélie andrea andreas andrew andrés anita anke anna anne antoine antonio astrid barbara beatriz begoña benoît bernd birgit björn brigitte camille carla carlos carmen caroline catherine chiara chloé christian christine claire clara claudia daniel david davide declan diego dieter elena elias elisabeth emily emma eric erik eva fabian fatima felix fernando fiona francesca franz françois frank gabriel george giulia grace greta hannah hans heike heinrich helen helga hélène henry hugo ian ibrahim inés ingrid isabel íñigo jack jacques jakob james jan jane javier jean jean-marc jennifer joan johann john jonas jorge josé juan julia jürgen karin karl karl-heinz katrin klaus laura leila léa lena leon li linda lisa louis luc luca lucas lucía luis lukas maja manuel marc marco margaux maria marie mario mark marta martin mary matthias mehmet mei michael miguel mohammed monika nadia ngozi nicolas nina noémie olga oliver olivia omar pablo paolo patrick paul pedro peter petra philippe pierre priya rachel rafael raj renate robert rosa ruth sabine samuel sandra sara sarah sebastian simon sofia sophie stefan susanne sven sylvie thomas tim tomasz ulrich ursula uwe victor walter wei werner yasmin yuki yves zoé maría étienne".split()
)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    text: str
    features: list[float] = field(default_factory=list)
    label: int | None = None  # 1 or 0 in made sentences


_AT = r"(?:@|&\#64;|&\#x40;|\s?[\[({<]\s?(?:at|AT|arroba)\s?[\])}>]\s?|\sAT\s|\s@\s|\sat\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|&\#46;|\s?[\[({<]\s?(?:dot|DOT|punto|point|punkt)\s?[\])}>]\s?|\s(?:DOT|dot)\s)"
EMAIL = regex.compile(rf"(?<![\w.+%-])[\w](?:[\w.+%'-]{{0,63}}[\w+-])?{_AT}[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?(?:{_DOT}[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?)*{_DOT}\p{{L}}{{2,18}}(?![\w@])")
PHONE = regex.compile(r"(?<![\w.,/-])(?<!\d[ :])(?:\+|00)?\(?\d{1,5}\)?(?:[ .\-/]{0,2}\(?\d{1,9}\)?){0,7}(?![\w@]|[.,:/-]\d|-\w)")
ID = regex.compile(
    r"(?<![\w./-])(?:[A-Z]{5}-?\d{6}-?[A-Z0-9]{5}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]\d{2}[A-Z]\d{6}[A-Z]\d|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{2}/\d{8}/\d{2}|\d{2}[A-Z]{2}\d{5}"
    r"|[A-Z]{1,3}-?\d{6,9}(?:[ -]?[A-Z](?![a-z]))?|[XYZ]-?\d{7}-?[A-Z]|\d{2}\.?\d{3}\.?\d{3}[ -]?[A-Z]|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{15}|\d{13}|\d{8,12}|[A-Z0-9]{9,12}|\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3})(?![\w-]|[./]\w)",
    regex.IGNORECASE,
)
_TOWN = r"(?-i:\p{Lu}[\p{L}'-]+(?: \p{Lu}\p{Ll}[\p{L}'-]+)?)"
_TOWN_ANY = r"[\p{L}][\p{L}'-]+"
_ENG = r"(?:street|st|road|rd|drive|dr|lane|ln|row|close|terrace|avenue|ave|court|ct|way|boulevard|blvd|crescent|place|pl|mews|parade|hill|gardens|grove|walk|square|sq|highway|hwy|circle|cir)"
_UNIT = r"(?:,? ?(?:apt|unit|flat|suite|ste|room|rm|apartment)\.? ?\w{1,6}|,? ?\#\w{1,6})"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?)"
_GAP = r"(?:\s*[,;·]\s*|\s*\r?\n\s*|\s+-\s+)"
ADDRESS = [
    regex.compile(rf"(?<![\w.,/#-])\d{{1,5}}[A-Z]?(?:-\d{{1,4}}[A-Z]?)?,? (?:(?:[NSEW]\.?|north|south|east|west)\s)?(?:[\p{{L}}'-]+ ){{1,3}}{_ENG}\b\.?{_UNIT}?(?:{_GAP}{_TOWN}(?:(?:,? ?| ){_POST}|{_GAP}{_POST})?)?", regex.IGNORECASE),
    regex.compile(rf"(?<![\w.,/#-])\d{{1,5}}[a-z]?(?:-\d{{1,4}}[a-z]?)?,? (?:[\p{{Ll}}'.-]+ ){{1,3}}{_ENG}\b\.?{_UNIT}?(?:{_GAP}{_TOWN_ANY}(?: {_TOWN_ANY})?(?:,? ?{_POST.lower()})?)?(?=\s*(?:\r?\n|$|[,;.<\"]))", regex.IGNORECASE),
    regex.compile(rf"(?<![\w-])(?:(?:[\p{{L}}-]+(?:straße|strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer|steig|hof|chaussee|markt|berg))|(?:(?:obere|untere|alte|neue|am|an der|an den|auf der|auf dem|im|in der|zum|zur|hinter dem|unter den|bei der)\s[\p{{L}}-]+(?:straße|strasse|str\.)?)) \d{{1,4}}(?: ?[a-z](?![\p{{L}}]))?(?:[-/]\d{{1,4}}[a-z]?)?(?:{_GAP}(?:D-)?\d{{5}} {_TOWN})?", regex.IGNORECASE),
    regex.compile(rf"(?<![\w.,/#-])\d{{1,4}}(?:,? ?(?:bis|ter|quater|[a-d])\b)?,? (?:rue|avenue|av\.|quai|place|pl\.|bd|boulevard|boul\.|impasse|chemin|ch\.|allée|allées|cours|route|square|passage|villa|cité|faubourg|montée|sentier)\s(?:(?:de la|de l'|des|du|de|d'|le|la|les|aux|au)\s?)?[\p{{L}}'-]+(?: (?:de la |de l'|des |du |de |d')?\p{{Lu}}[\p{{L}}'-]+){{0,3}}(?:(?:{_GAP}|\s+)(?:F-)?\d{{5}} {_TOWN}(?:[- ](?:sur|sous|les|lès)[- ][\p{{L}}-]+)?)?", regex.IGNORECASE),
    regex.compile(rf"(?<![\w])(?:c/|calle|avda\.?|avenida|av\.|paseo|p\.º|plaza|pza\.|pl\.|camino|carretera|ctra\.|ronda|travesía|cuesta|glorieta|rambla|vía)\s(?:(?:de las|de los|de la|del|de|el|la|las|los)\s)?[\p{{L}}'-]+(?: (?:de las |de los |de la |del |de )?\p{{Lu}}[\p{{L}}'-]+){{0,2}},? (?:n\.?[º°o]\.? ?|núm\.? ?|num\.? ?)?\d{{1,4}}(?:,? (?:bajo|ático|entlo\.?|izda\.?|dcha\.?|\d{{1,2}}\.?[ºª°](?: ?(?:[A-H]|izda\.?|dcha\.?)\b)?))*(?:{_GAP}(?:E-)?\d{{5}} {_TOWN})?", regex.IGNORECASE),
]

_PART = r"(?i:van der|van den|van|von der|von|de la|de los|de las|del|de|den|der|ter|di|da|dos|el|al|bin|ben|le|la) "
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|'(?=\p{Lu}))+"
_SUR = rf"(?:{_PART}){{0,2}}{_WORD}(?:-{_WORD})?"
_GIV = r"\p{Lu}[\p{L}\p{M}]+(?:-\p{Lu}[\p{L}\p{M}]+)?"
_FIRM = re.compile(NAME_BEFORE, re.IGNORECASE)
_TITLE = re.compile(rf"(?:{TITLES})\.?", re.IGNORECASE)
NAME_FORMS = [
    ("given", regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.'-])(?P<g>{_GIV}(?: {_GIV}){{0,1}}?)(?P<i>(?: \p{{Lu}}\.){{0,2}}) (?P<s>{_SUR})(?![\p{{L}}\p{{N}}_@])", regex.V1)),
    ("comma", regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.'-])(?P<s>{_SUR}), (?P<g>{_GIV}(?: {_GIV})?|\p{{Lu}}\.)(?P<i>(?: \p{{Lu}}\.){{0,2}})(?![\p{{L}}\p{{N}}_@])", regex.V1)),
    ("initial", regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.'/-])(?P<g>\p{{Lu}}\.(?:[ -]?\p{{Lu}}\.){{0,2}})(?P<i>) ?(?P<s>{_SUR})(?![\p{{L}}\p{{N}}_@])", regex.V1)),
    ("given", regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.'-])(?P<g>{_GIV} {_GIV})(?P<i>(?: \p{{Lu}}\.){{0,2}}) (?P<s>{_SUR})(?![\p{{L}}\p{{N}}_@])", regex.V1)),
]
#: Where a name may begin: at a capital, or at a particle of a family name that comes first.
_CAPITAL = re.compile(r"(?<![\w@.'-])[^\W\d_a-z]")
_PARTICLE = re.compile(r"(?<![\w@.'-])(?:van|von|del?|den|der|ter|di|da|dos|el|al|bin|ben|le|la) ", re.IGNORECASE)
_LOWER_WORD = regex.compile(r"(?<![\p{L}\p{N}_@.'-])\p{Ll}{2,}(?:-\p{Ll}+)?(?= )")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_LOWER_REST = regex.compile(rf"(?P<i>(?: \p{{Ll}}\.){{0,2}}) (?P<s>(?:{_PART}){{0,2}}(?:\p{{Ll}}')?\p{{Ll}}{{4,}}(?:-\p{{Ll}}+)?)(?![\p{{L}}\p{{N}}_@'-])")
_FIELD_NAME = regex.compile(r"(?im)^[ \t>*-]*(?:full name|name|nom et prénom|nom|nombre|nome|vor- und nachname)[ \t]*(?:\.{3,}|[:|=]|\t)[ \t]*(?P<v>[^\r\n|<>\"]{3,60}?)[ \t]*$")
_LINE_NAME = regex.compile(rf"(?m)^[ \t>]*(?P<v>[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}'. ,-]{{3,45}})[ \t]*\r?$")


def _before(text: str, start: int, n: int = 36) -> str:
    return text[max(0, start - n) : start].lower()


@lru_cache(maxsize=64)
def _ends_with(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[^\w])(?:{words})(?:\s*(?:no|nr|number|nummer|n°|nº|n\.º|núm)?\.?)?\s*(?:\.{{3,}}|[:=|#>«\"'(\[])*\s*[\"'<(\[]?\s*$")


def labelled(text: str, start: int, words: str, n: int = 40) -> bool:
    """Whether one of `words` stands directly before, with what usually joins a label and its value."""
    return bool(_ends_with(words).search(_before(text, start, n)))


def _next_word(text: str, end: int) -> str:
    m = re.match(r"[ \t-]{0,2}([^\W\d_][\w'-]*)", text[end : end + 24])
    return m.group(1).lower() if m else ""


def _last_word(text: str, start: int) -> str:
    m = re.search(r"([^\W\d_][\w'’-]*)\.?[ \t-]{1,2}$", text[max(0, start - 26) : start])
    return m.group(1).lower() if m else ""


def fold(s: str) -> str:
    """Letters only, without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if c.isalpha() and ord(c) < 0x250)


#: Texts to which the lexicon's counts are scaled down, so that thresholds mean the same for corpora of any size above.
RATE_TEXTS = 3_000
#: Times in so many texts below which a word in lower case, or a given name, counts as not met: less than any threshold asks for.
LEAST = {"lower": 1.000001, "given": 0.5, "ends": 0.0, "other_ends": 0.0, "caps": 1.000001, "near": 1.000001}
#: Times in so many texts above which a word in lower case begins or ends no name that is not known otherwise.
COMMON_FIRST, COMMON_LAST = 20, 50
_WORDS = re.compile(r"(?<![\w@.+-])[^\W\d_]{2,}(?![\w@+-]|\.\w)")
_AT_PLACE = regex.compile(r"\b(?:in|at|near|over|to|from|of|bei|nach|aus|über|von|zu|à|en|de|vers|desde|hacia) (\p{Lu}\p{Ll}{2,})")
_OTHER_END = regex.compile(r"(?:[,.]|\b(?:in|at|near|aus|à|en)) (\p{Lu}\p{Ll}{4,})")


def _grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]


class Lexicon:
    """What all texts of a corpus tell of words: how often each stands in lower case, with a capital, and with a capital after a word of
    place; and which given names and ends of family names stand in labelled name fields; each text counts as a whole. Counts are of RATE_TEXTS texts; of fewer texts they stay as
    they are. The rates of words of one kind sum up to what RATE_TEXTS mean texts hold, so few words reach a threshold, however
    large the corpus; ends are of four letters at most."""

    def __init__(self) -> None:
        self.lower, self.given, self.ends, self.other_ends, self.caps, self.near = (Counter() for _ in range(6))
        self.grams, self.told = None, {}

    def add(self, text: str) -> None:
        for w, n in Counter(_WORDS.findall(text)).items():
            if w.islower():
                self.lower[w] += n
            elif len(w) > 2 and w[0].isupper() and w[1:].islower():
                self.caps[w] += n
        self.near.update(_AT_PLACE.findall(text))
        for m in _FIELD_NAME.finditer(text):
            v = m.group("v")
            got = regex.fullmatch(rf"(?P<g>{_GIV}(?: {_GIV})?)(?: \p{{Lu}}\.)* (?P<s>{_SUR})", v) or regex.fullmatch(rf"(?P<s>{_SUR}), (?P<g>{_GIV})", v)
            if got:
                self.given.update([got["g"].split()[0].lower()])
                self.ends.update([fold(got["s"])[-4:]])
        self.other_ends.update(fold(w)[-4:] for w in _OTHER_END.findall(text))

    def rated(self, texts: int) -> Lexicon:
        """The counts of so many texts as rates, without words too rare for any threshold."""
        scale = min(1.0, RATE_TEXTS / max(1, texts))
        for kind, least in LEAST.items():
            setattr(self, kind, Counter({w: n * scale for w, n in getattr(self, kind).items() if n * scale >= least}))
        self.grams, self.told = None, {}
        return self

    def __getstate__(self):
        return {k: dict(v) for k, v in self.__dict__.items() if k in LEAST}

    def __setstate__(self, state):
        self.__dict__.update({k: Counter(v) for k, v in state.items()})
        self.grams, self.told = None, {}

    def name_like(self, token: str) -> float:
        """How much more the token's letters, three by three, look like a given name than like a word of running text: mean log-odds."""
        if self.grams is None:
            sides = [Counter(g for w in words for g in _grams(w)) for words in (GIVEN, (w for w in self.lower if len(w) > 3))]
            self.grams = [(c, math.log(sum(c.values()) + 2_000)) for c in sides]
        if token not in self.told:
            (a, na), (b, nb) = self.grams
            grams = _grams(token.lower())
            self.told[token] = sum(math.log(a[g] + 0.2) - na - math.log(b[g] + 0.2) + nb for g in grams) / len(grams)
            if len(self.told) > 200_000:
                self.told.clear()
                return self.name_like(token)
        return self.told[token]

    def is_given(self, token: str) -> int:
        t = token.lower()
        return 2 if t in GIVEN else 1 if self.given[t] else 2 if "-" in t and all(x in GIVEN for x in t.split("-")) else 0

    def place_rate(self, token: str) -> float:
        """How often the word stands after a word of place, of all its times with a capital; 0 for words hardly met."""
        return self.near[token] / (self.caps[token] + 2.0)

    def surname_like(self, token: str) -> float:
        e = fold(token)[-4:]
        return min(5, self.ends[e]) - min(5, self.other_ends[e] / 4)


#: Places of two of a name's features: whether its first word is a known given name, and whether it begins a sentence.
KNOWN, AT_START = 0, 27


def names(text: str, lex: Lexicon, mails: set[str]) -> Iterable[Candidate]:
    seen: set[tuple[int, int]] = set()

    def made(start: int, end: int, given: str, initials: str, sur: str, form: int, is_field: bool) -> Candidate:
        first = given.split()[0] if given else ""
        plain_sur = sur.split()[-1] if sur else ""
        after, before = _next_word(text, end), _last_word(text, start)
        know = lex.is_given(first)
        line = (start == 0 or text[start - 1] in "\n\r>") and (end == len(text) or text[end] in "\r\n,<")
        cue = labelled(text, start, CUES) or labelled(text, start, TITLES, 12)
        bad_after, bad_before = bool(re.fullmatch(NAME_AFTER, after)), bool(re.fullmatch(NAME_BEFORE, before))
        article = bool(re.fullmatch(r"the|der|die|das|dem|den|le|la|el|les|los|del|du|au", before))
        lower_sur, lower_giv = lex.lower[plain_sur.lower()], lex.lower[first.lower()]
        parts = [fold(p) for p in re.split(r"[-\s]", sur) if len(p) > 2]
        mailed = any(len(p) > 3 and p in mails for p in parts) or (bool(fold(sur)) and len(fold(sur)) > 3 and any(fold(sur) in m for m in mails))
        label = is_field or labelled(text, start, LABELS["name"], 16)
        letters = [c for c in sur if c.isalpha()]
        f = [
            know, form, len(initials) > 0, label, cue, bad_after, bad_before, article, line,
            min(lower_sur, 20), min(lower_giv, 20), lex.surname_like(plain_sur), mailed, all(c.isupper() for c in letters) if letters else 0, sur[:1].islower() and " " not in sur,
            "-" in sur, " " in sur.strip(), len(plain_sur), bool(re.match(r"[ \t][A-ZÀ-Þ]", text[end : end + 2])), bool(re.search(r"[a-zà-ÿ] $", text[max(0, start - 2) : start])),
            len(given.split()), bool(re.fullmatch(TITLES, before)), lex.is_given(plain_sur) == 2,
            lex.place_rate(first), lex.place_rate(plain_sur), min(lex.caps[plain_sur], 50), min(lex.caps[first], 50), not text[max(0, start - 2) : start].strip(" \t") or text[max(0, start - 2) : start].strip(" \t")[-1] in ".!?:\n", bool(re.match(r" [a-zà-ÿ]", text[end : end + 2])), text[end : end + 2] == "'s", bool(re.match(r"[.,;:)\n]", text[end : end + 1])), end == len(text),
            bool(re.fullmatch(PLACE_BEFORE, before)), lex.name_like(first) if len(first.strip(".")) > 1 else 0.0, lex.name_like(plain_sur),
        ]
        c = Candidate("name", start, end, text[start:end], [float(x) for x in f])
        return c

    capitals = [m.start() for m in _CAPITAL.finditer(text) if m.group().isupper()]
    family = sorted({*capitals, *(m.start() for m in _PARTICLE.finditer(text))})
    for k, (form, pattern) in enumerate(NAME_FORMS):
        for m in filter(None, (pattern.match(text, at) for at in (capitals if form != "comma" else family))):
            given, start, end = m["g"], m.start(), m.end()
            words = given.split()
            if form == "given" and len(words) == 2 and not all(lex.is_given(w) or lex.name_like(w) > 0 for w in words):
                continue
            if form == "given" and not lex.is_given(words[0]) and (lex.lower[words[0].lower()] > COMMON_FIRST or lex.lower[m["s"].split()[-1].lower()] > COMMON_LAST):
                continue  # words of running text that begin a sentence
            if form == "given" and (_TITLE.fullmatch(words[0]) or (_FIRM.fullmatch(words[0]) and not lex.is_given(words[0]))):
                continue  # a title belongs to no name, and a word of firms begins one of theirs
            if form == "comma" and not (lex.is_given(words[0]) or "." in given or lex.name_like(words[0]) > 0):
                continue
            if (start, end) not in seen:
                seen.add((start, end))
                yield made(start, end, given, m["i"] or "", m["s"], k, False)
    for m in _LOWER_WORD.finditer(text) if not GIVEN.isdisjoint(_PLAIN_WORD.findall(text)) else ():
        if lex.is_given(m.group()) == 2 and (r := _LOWER_REST.match(text, m.end())) and (lex.surname_like(r["s"]) >= 1 or fold(r["s"]) in mails) and lex.lower[r["s"].split()[-1]] <= 2 and (m.start(), r.end()) not in seen:
            seen.add((m.start(), r.end()))
            yield made(m.start(), r.end(), m.group(), r["i"] or "", r["s"], 0, False)
    for is_field, pattern in ((True, _FIELD_NAME), (False, _LINE_NAME)):
        for m in pattern.finditer(text):
            v, start, end = m["v"].rstrip(" ,."), m.start("v"), m.start("v") + len(m["v"].rstrip(" ,."))
            if (start, end) in seen or not (3 < len(v) < 50) or sum(c.isalpha() for c in v) < 4:
                continue
            words = [w for w in re.split(r"[ ,]+", v) if w]
            if ".." in v or not 2 <= len(words) <= 6 or (not is_field and not any(lex.is_given(w) == 2 for w in (words[0], words[-1]))):
                continue
            comma = "," in v
            first = words[-1] if comma else words[0]
            rest = " ".join(words[:-1]) if comma else " ".join(w for w in words[1:] if not re.fullmatch(r"\w\.", w))
            if not rest or (not is_field and (len(words) > 4 or any(lex.lower[w] > 4 for w in rest.lower().split()))):
                continue
            seen.add((start, end))
            yield made(start, end, first, "", rest, 2 if re.fullmatch(r"\w\.", first) else 1 if comma else 0, is_field)


_SOME_AT = re.compile(r"@|&#|[\[({<]\s?(?:at|AT|arroba)\b|\sAT\s|\sat\s[\w-]+\s(?:dot|DOT)\s")


def emails(text: str) -> Iterable[Candidate]:
    if not _SOME_AT.search(text):
        return
    for m in EMAIL.finditer(text):
        t = m.group()
        ending = re.split(r"[^\w]", t.rstrip())[-1].lower()
        picture = ending in {"png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "tif", "tiff", "raw", "arw", "cr3", "nef", "orf", "dng", "heic", "mp4", "xmp"}
        f = [picture, labelled(text, m.start(), LABELS["email"]), "@" not in t, len(t), t.count("."), bool(re.search(r"@\dx\.", t)), text[m.end() : m.end() + 2].startswith(":/"), any(c.isspace() for c in t), bool(re.search(r"@", t)) and t.split("@")[0].isdigit()]
        yield Candidate("email", m.start(), m.end(), t, [float(x) for x in f])


_DATE = re.compile(r"(?:19|20)\d\d[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])(?!\d)|\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d\d(?!\d)")
_NATIONAL = re.compile(r"(?:\d{3}[ .-]\d{3}[ .-]\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|1[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{4}|\d{3}([ -])\d{3}\1\d{3}|\d{3} \d{2} \d{2} \d{2}|\(?0\d{1,4}\)?[ ./-]?\d{2,8}(?:[ .-]?\d{2,6}){0,4})")


def phones(text: str) -> Iterable[Candidate]:
    for m in PHONE.finditer(text):
        t = m.group().rstrip(" .-/(")
        digits = sum(c.isdigit() for c in t)
        if not 7 <= digits <= 15 or t.count("(") != t.count(")"):
            continue
        start, end = m.start(), m.start() + len(t)
        if t[0] == "(" and ")" not in t:
            continue
        world, national = t.startswith(("+", "00")) and digits >= 9, bool(_NATIONAL.fullmatch(t))
        day = _DATE.match(t)
        dated = bool(day) and t[day.end() :][:1] in ("", " ")
        label, wrong = labelled(text, start, LABELS["phone"]), labelled(text, start, NOT_PHONE) or labelled(text, start, LABELS["id_number"])
        line = (start == 0 or text[start - 1] in "\n\r") and (end == len(text) or text[end] in "\r\n")
        groups = re.split(r"\D+", t.strip("+()"))
        f = [world, national, dated, label, wrong, line, digits, len(groups), max(map(len, groups)), t.startswith("0"), t.startswith("+"), "(" in t, "/" in t, "." in t, "-" in t, " " in t, text[start - 1 : start] == "-", bool(re.match(r"\s?(?:bytes|kb|mb|px|m\b|s\b|mm)", text[end : end + 8].lower()))]
        yield Candidate("phone", start, end, t, [float(x) for x in f])


#: Where a number may begin: a digit after few letters.
_ID_START = re.compile(r"(?<![\w./-])(?=[A-Za-z]{0,7}[ -]?\d)[A-Za-z0-9]")
_HOUSE = re.compile(r"(?<![\w.,/#-])\d")


def _matches(pattern: regex.Pattern, starts: re.Pattern, text: str) -> Iterable:
    """Matches of a pattern, which is tried only where `starts` matches; none overlaps the one before."""
    end = 0
    for s in starts.finditer(text):
        if s.start() >= end and (m := pattern.match(text, s.start())):
            yield m
            end = m.end()


def id_numbers(text: str) -> Iterable[Candidate]:
    for m in _matches(ID, _ID_START, text):
        t, start = m.group(), m.start()
        digits = sum(c.isdigit() for c in t)
        if digits < 5:
            continue
        label = labelled(text, start, LABELS["id_number"], 60)
        file = bool(re.match(r"\.\w{3,4}\b", text[m.end() : m.end() + 5]))
        wrong = labelled(text, start, "order no|order|serial|serialnumber|frame|index|batch|size|mtime|copied|hash|bytes|n° de série|build|is|imageuniqueid") or labelled(text, start, LABELS["phone"])
        spaced = " " in t or "-" in t or "/" in t or "." in t
        f = [label, file, wrong, digits, len(t), t.isdigit(), sum(c.isalpha() for c in t), spaced, t != t.upper(), bool(_DATE.match(t)), bool(re.search(r"[a-f\d]{9,}", t)) and not t.isdigit(), (start == 0 or text[start - 1] in "\n\r"), text[max(0, start - 1) : start] in "+/_"]
        yield Candidate("id_number", start, m.end(), t, [float(x) for x in f])


def _cut_town(t: str, lex: Lexicon) -> str:
    """An address without a last word that only begins the next sentence: a short or common one after the town."""
    m = re.search(r"[^\W\d_] ([^\W\d_]+)$", t)
    if m and m.group(1)[0].isupper() and re.search(r"[,;·\n-]\s*(?:\w-)?(?:\d{5} )?[^\W\d_][\w'-]* [^\W\d_]+$", t) and (len(m.group(1)) < 4 or lex.lower[m.group(1).lower()] > 1):
        return t[: m.start(1)].rstrip()
    return t


#: Patterns of ADDRESS that begin with a house number; and parts of words, in lower case, without one of which the others cannot match.
NUMBER_FIRST = (0, 1, 3)
SOME_STREET = {
    2: ("straße", "strasse", "str.", "allee", "weg ", "gasse", "platz", "ring ", "damm", "ufer", "steig", "hof ", "chaussee", "markt", "berg ", "obere", "untere", "alte", "neue", "am ", "an der", "an den", "auf de", "im ", "in der", "zum", "zur", "hinter", "unter den", "bei der"),
    4: ("c/", "calle", "avda", "avenida", "av.", "paseo", "p.º", "plaza", "pza", "pl.", "camino", "carretera", "ctra", "ronda", "travesía", "cuesta", "glorieta", "rambla", "vía"),
}


def addresses(text: str, lex: Lexicon) -> Iterable[Candidate]:
    low = text.lower()
    for k, pattern in enumerate(ADDRESS):
        if k in SOME_STREET and not any(w in low for w in SOME_STREET[k]):
            continue
        for m in _matches(pattern, _HOUSE, text) if k in NUMBER_FIRST else pattern.finditer(text):
            t = _cut_town(m.group().rstrip(" ,;-·"), lex)
            if t.endswith(".") and len(re.split(r"\W", t[:-1])[-1]) > 4:
                t = t[:-1]  # the end of a sentence, not of an abbreviation
            start, end = m.start(), m.start() + len(t)
            post = bool(re.search(r"\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}", t[4:]))
            label = labelled(text, start, LABELS["address"])
            line = start == 0 or text[start - 1] in "\n\r"
            ends = end == len(text) or text[end] in "\r\n,;.<\""
            head = re.match(r"\d+", t)
            f = [k, post, label, line, ends, len(t), len(t.split()), "\n" in t, int(head.group()) if head else 0, sum(w[:1].isupper() for w in t.split()) / len(t.split()), bool(re.fullmatch(r"box|album|[a-zà-ÿ]{6,}s", _next_word(text, end))), bool(re.search(r"\b(?:minutes|pictures|frames|negatives|photos|files|images|dateien|bilder|negativen|hours|scans|prints|mm|picks|fotos|of|the|and|was|is|in|from|to|der|die|das|sind)\b", t.lower().split("\n")[0]))]
            yield Candidate("address", start, end, t, [float(x) for x in f])


def candidates(text: str, lex: Lexicon) -> list[Candidate]:
    """All proposed spans of a normal-form text; they may overlap."""
    mail = list(emails(text))
    locals_ = set()
    for c in mail:
        head = regex.split(r"@|&#64;|\s?[\[(]\s?at|\sAT\s", c.text, maxsplit=1, flags=regex.IGNORECASE)[0].lower()
        locals_ |= {fold(p) for p in re.split(r"[._+-]", head)} | {fold(head)}
    return [*mail, *phones(text), *id_numbers(text), *addresses(text, lex), *names(text, lex, locals_ - {""})]
