"""Personal information in free text: patterns propose spans, check digits confirm or refute them, words nearby move their score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: A span counts from this score on.
CUTOFF = 1.0
#: Characters before and after a span in which words move its score.
NEAR = 48

_SEP = r"[ .\-‐‑‒–  ]"
_L = r"[^\W\d_]"

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
_DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|DOT|Dot)\s*[\)\]\}>]\s*|\s+(?:dot|DOT|Dot|punkt|point|punto)\s+|\.)"
_AT = r"(?:\s*[\(\[\{<]\s*(?:at|AT|At|ät|@)\s*[\)\]\}>]\s*|\s+(?:at|AT|At|arroba|arobase)\s+|\s+@\s+)"
_SPOKEN = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:{_DOT}[\w+%-]+)*({_AT})[\w-]+(?:{_DOT}[\w-]+)+(?![\w-])")
_AT_SIGN = re.compile(r"(?i)[\s(\[{<](?:at|ät|arroba|arobase|@)[\s)\]}>]")
_HOST = re.compile(rf"\s*[)\]}}>]?\s*[\w-]+{_DOT}[\w-]+")
_DOT_BEFORE = re.compile(r"(?i)(?:\b(?:dot|punkt|point|punto)|\.)[)\]}>]?\s*$")
_DOT_BEHIND = re.compile(r"(?i)\s*[(\[{<]?\s*(?:(?:dot|punkt|point|punto)\b|\.\w)")
#: Last parts a written-out address may end in.
_TOP = frozenset("com org net edu gov info io example test invalid local de fr es it nl pl uk eu us jp cn tr se at ch be pt".split())

_PHONES = [
    re.compile(rf"(?<![\w+.-])(?:\+?1{_SEP}?)?(?:\(\d{{3}}\){_SEP}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w+.-])\+\d{10,14}(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w+.-])(?:\+|00)\d{{1,3}}(?:{_SEP}|/)?\(?\d{{1,5}}\)?(?:(?:{_SEP}|/)\(?\d{{2,8}}\)?){{1,4}}(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w+.-])0\d{2,4}[/ ]\d{5,9}(?![\w-]|[./]\d)"),
    re.compile(rf"(?<![\w+.-])0\d{{1,4}}(?:{_SEP}\d{{2,4}}){{2,4}}(?![\w-]|\.\d)"),
]
#: Words near a telephone number.
_PHONE_NEAR = re.compile(r"(?i)\b(?:phone|tel|tél|telefon|teléfono|téléphone|call|ring|ruf|mobile|mobil|cell|fax|text me|whatsapp|on-call|reach\w*|joignable|erreichbar|rückfragen|hotline|móvil|llam\w+|message|ext)\b|电话|電話|هاتف|اتصل")

_IDS = [
    ("digits9", re.compile(r"(?<![\w.+/-])\d{3}(?P<s>[ -])\d{2}(?P=s)\d{4}(?![\w/-]|\.\d)")),
    ("insurance", re.compile(r"(?i)(?<![\w.+/-])[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?![\w/-])")),
    ("digits11", re.compile(r"(?<![\w.+/-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w/-]|[. ]\d)")),
    ("digits15", re.compile(r"(?<![\w.+/-])\d ?\d{2} ?\d{2} ?(?:\d{2}|2[ABab]) ?\d{3} ?\d{3} ?\d{2}(?![\w/-]|\.\d)")),
    ("letter23", re.compile(r"(?<![\w.+/-])[XYZxyz]?-?\d{7,8}-?[A-Za-z](?![\w/-])")),
    ("card", re.compile(r"(?<![\w.+/-])\d{4}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{4}(?![\w/-]|\.\d)")),
    ("coded", re.compile(r"(?<![\w.+/-])[A-Z]{1,3}[ -]?\d{6,9}[A-Z]?(?![\w/-])")),
    ("plain", re.compile(r"(?<![\w.+/-])\d{8,10}(?![\w/-]|\.\d)")),
]
#: Words near a personal number.
_ID_NEAR = re.compile(
    r"(?i)\b(?:ssn|social|insurance|national[_ ]?id|id card|identity|identit\w+|passport|passeport|pasaporte|reisepass|ausweis|personal (?:number|no)|citizen\w*|tax|steuer\w*|nino|nif|nie|dni|insee|applicant|"
    r"kennzahl|versichert\w*|assuré\w*|asegurad\w*|document\w*|sécurité|seguridad|personalausweis|kimlik|tc|patient|resident|id)\b|身份证|护照|身分証|旅券|هوية|جواز"
)
#: Words beside numbers that identify nobody.
_NOT_PERSON = re.compile(r"(?i)\b(?:row|rows|value|offset|version|build|section|range|commit|batch|overflows|took|matched|cells|seconds|sheet|folio|report|ledger|memo|key|code)\W*$")
_LETTERS23 = "TRWAGMYFPDXBNJZSQVHLCKE"

_HOUSE = r"\d{1,4}(?:[a-zA-Z](?![\w])|\s(?:bis|ter|quater)\b)?"
_PLACE = rf"(?:{_L}[\w'’-]*)"
#: Kinds of streets, by where they stand.
_AFTER = r"(?:street|road|avenue|ave|lane|court|close|terrace|crescent|way|drive|square|grove|gardens|boulevard|blvd|place|row|hill|rd|dr|ln|ct|st)"
_BEFORE_FR = r"(?:rue|avenue|chemin|boulevard|place|quai|impasse|allée|cours|route|passage|square)"
_BEFORE_ES = r"(?:calle|avenida|plaza|paseo|camino|ronda|travesía|carrera|via|viale|piazza|corso|rua|largo|praça|ulica|ul\.|c/)"
_ADDRESSES = [
    (re.compile(rf"(?i)(?<![\w.,/:-])(?<!\d )\d{{1,4}}[a-z]?(?: bis| ter)? (?:{_L}[\w'’-]* ){{1,3}}?{_AFTER}\b(?!-)(?:(?<= st)\.)?"), re.compile(r"\d")),
    (re.compile(rf"(?i)(?<![\w-]){_L}[\w-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)\s+\d{{1,4}}(?: ?[a-z](?![\w]))?(?![\w-])"), re.compile(r"(?i)(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)\s+\d")),
    (re.compile(rf"(?i)(?<![\w.-])\d{{1,4}}[a-z]?(?:[ ](?:bis|ter|quater))?,?\s+{_BEFORE_FR}\s+(?:(?:de la|du|des|de)\s+|(?:de l|d)['’])?{_L}[\w'’-]*"), re.compile(rf"(?i)\b{_BEFORE_FR}\s")),
    (re.compile(rf"(?i:(?<![\w-]){_BEFORE_ES}\s+(?:(?:de la|de los|de las|del|de)\s+)?){_L}[\w'’-]*(?:\s+[A-ZÀ-Þ][\w'’-]+)*,?\s+(?:(?i:nº|n°|núm\.?|no\.?|nr\.?|numero)\s*)?\d{{1,4}}(?:\s(?:bis|ter)\b|[a-zA-Z](?![\w]))?(?![\w-])"), re.compile(rf"(?i)(?<![\w-]){_BEFORE_ES}\s")),
    (re.compile(r"(?<![\w-])[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)*\s+(?:Sokak|Sokağı|Caddesi|Cadde|Cad\.|Sok\.|Bulvarı)(?:,?\s+(?:No|no|Nr)[:.]?)?\s*\d{1,4}[a-zA-Z]?(?![\w-])"), re.compile(r"Sok|Cad|Bulv")),
]

#: Particles of family names, titles, and words a name follows or precedes.
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|vom|zu|zur|de la|de las|de los|del|dela|de|da|dos|du|des|di|della|le|la|el|al|bin|ibn|ben|ter|ten|den|der|af|av|abu|st\.)"
_TITLES = frozenset("mr mrs ms miss dr prof professor frau herr fräulein mme m mlle monsieur madame don doña dona señor señora sr sra sir lady signor signora bay bayan hr fr dra".split())
_UP = r"[A-ZÀ-ÞĀĂĄĆČĎĐĒĘĚĞĢİĪŁŃŇŌŐŒŘŚŞŠŤŪŮŹŻŽ]"
_GIVEN = rf"(?:{_UP}(?:{_L}|['’](?={_L}))+(?:-{_L}+)?)"
_FAMILY = rf"(?:(?:{_PARTICLE} )*(?:al-|el-|d['’]|l['’]|O['’]|Mac|Mc)?{_UP}{_L}+(?:['’]{_L}+)?(?:-{_L}+)*)"
_CAPS = r"(?:[A-ZÀ-ÞİŞĞĆČŁŚŻŹ]{2,}(?:-[A-ZÀ-ÞİŞĞĆČŁŚŻŹ]+)*)"
_NAMES = [
    ("first", re.compile(rf"(?<![\w.-])(?P<g>{_GIVEN}|{_UP}\.(?:[ -]?{_UP}\.)?)(?P<gap>\s{{1,2}})(?:{_UP}\.?(?:\s{_UP}\.)* )?(?P<f>{_FAMILY})(?![\w@]|-\d)")),
    ("caps", re.compile(rf"(?<![\w.-])(?P<g>{_CAPS}|{_UP}\.)(?P<gap>\s{{1,2}})(?:{_UP}\. ?)*(?P<f>(?:(?i:{_PARTICLE}) )*(?:AL-|MAC|MC|O['’]|D['’])?{_CAPS})(?![\w@]|-\d)")),
    ("last", re.compile(rf"(?<![\w.-])(?P<f>{_FAMILY}),(?P<gap> ?)(?P<g>{_GIVEN}|{_UP}\.)(?: {_UP}\.)?(?![\w@]|-\d)")),
    ("lastcaps", re.compile(rf"(?<![\w.-])(?P<f>(?:(?i:{_PARTICLE}) )*{_CAPS}),(?P<gap> ?)(?P<g>{_CAPS}|{_UP}\.)(?: {_UP}\.)?(?![\w@]|-\d)")),
    ("low", re.compile(rf"(?<![\w.'’-])(?P<g>{_L}{{2,}}|{_L}\.)(?P<gap>\s{{1,2}})(?:{_L}\. ?)?(?P<f>(?:{_PARTICLE} )*(?:al-|el-|mac|mc|o['’])?{_L}{{3,}}(?:-{_L}+)*)(?![\w@]|-\d)")),
    ("lowlast", re.compile(rf"(?<![\w.'’-])(?P<f>(?:{_PARTICLE} )*{_L}{{3,}}(?:-{_L}+)*),(?P<gap> ?)(?P<g>{_L}{{2,}}|{_L}\.)(?: {_L}\.)?(?![\w@]|-\d)")),
]
#: What stands right before or after a person's name: verbs with "by" or "with", titles, headings of fields; after it verbs of what persons do.
_DONE_BY = r"(?:written|annotated|reviewed|signed|approved|checked|prepared|reported|sent|filed|edited|tested|posted|labell?ed|said|made|seen)"
_DONE_WITH = r"(?:lunch|dinner|coffee|meeting|call|met|meet|spoke|speak|talk(?:ed)?|work(?:ed|s)?|agreed|discussed|checked|reviewed)"
_CUE_STRONG = re.compile(
    rf"(?i)(?:\b(?:{_DONE_BY} by|{_DONE_WITH} with|according to|thanks to|signed,|owner:|ask)\s|\b(?:mr|mrs|ms|miss|dr|prof|frau|herr|mme|mlle|don|doña|señora|señor)\.?\s|"
    r"\b(?:geprüft von|relu par|revisado por|selon|laut|según)\s|@|[\"'](?:reader|full_name)[\"']\s*:\s*[\"']|full_name\s*=\s*[\"'])$"
)
_CUE_BEFORE = re.compile(
    rf"(?i)(?:\b(?:{_DONE_BY} by|{_DONE_WITH} with|according to|thanks to|ask|signed,?|owner:?|author:?|contact:?|asked|by dr|said|cc|from|with|for|to)\s|"
    r"\b(?:mr|mrs|ms|miss|dr|prof|frau|herr|mme|mlle|m|don|doña|señora?|sra?|sir|bay|bayan)\.?\s|\b(?:geprüft von|relu par|revisado por|selon|laut|según|por|par|von|durch|de parte de)\s|@|"
    r"[\"'](?:reader|name|full_name|owner|author|user|annotator)[\"']\s*:\s*[\"']|(?:full_name|name|reader|owner)\s*=\s*[\"']|[|;]\s?|[(]|\n--\s+|\s--\s*\n\s*|\b(?:gruß|grüße|regards|cheers|saludos|cordialement|salutations),?\s+)$"
)
_CUES = re.compile(_CUE_STRONG.pattern[:-1])
_CUE_AFTER = re.compile(
    r"(?i)^(?:\s(?:please|reported|asked|said|says|wrote|noted|thinks|told|confirmed|agreed|suggested|found|saw|for \w+ing|and (?:i|we|she|he|they)|on (?:mon|tues|wednes|thurs|fri|satur|sun)day|"
    r"confirme|confirma|lo confirma|bestätigt|hat den|a signalé|avisó|stimmt)\b|[\"']\s*\}|\s?[|;]|, the \w+|, c['’]est|, vale)"
)
#: Words after a capitalised pair which show that it names a place or thing, and words that are no part of a name.
_PLACES = "quay point hill green basin locks reach spit yard town bay port park bridge beach lake river valley island harbour harbor station market hall farm mill wharf pier dock dump"
_PLACE_AFTER = re.compile(rf"(?i)^(?:\s(?:{_AFTER}|index|south|north|east|west|{'|'.join(_PLACES.split())})\b|-\d)")
_PLACE_WORDS = frozenset((_PLACES + " old south north east west upper lower road street lane avenue ave court close terrace crescent way rd st the and no select from where model").split())
#: Words of strong cues: only beside one of them a cue is looked for.
_CUE_WORDS = frozenset("by with to signed owner ask mr mrs ms miss dr prof frau herr mme mlle don doña señora señor von par por selon laut según reader name".split())
#: Of these one is a cue only behind a word that takes it.
_LINKS, _LINKED = frozenset(("by", "with", "to")), re.compile(rf"(?i)\W*(?:{_DONE_BY}|{_DONE_WITH}|according|thanks)")
_WORD = re.compile(r"[^\W\d_]+")
#: Six digits or more that belong together: no telephone or personal number has fewer.
_MANY_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}\d){5,}")
_TWO_CAPITALS = re.compile(r"[A-ZÀ-ÞİŞĞĆČŁŚŻŹ]{2}")
#: What a word may be part of.
_NAME, _CUE, _AT_WORD, _AFTER_WORD, _GERMAN, _BEFORE_WORD, _TURKISH = (1 << i for i in range(7))
_AFTER_WORDS = frozenset(_AFTER[3:-1].split("|"))
_BEFORE_WORDS = frozenset(w.strip("\\./") for w in (_BEFORE_FR[3:-1] + "|" + _BEFORE_ES[3:-1]).split("|"))
_AT_WORDS = frozenset(("at", "ät", "arroba", "arobase"))
_GERMAN_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig")
_PARTICLES = re.compile(rf"(?i)^(?:{_PARTICLE} )+")
_HEADS, _BETWEEN, _NUMBERED = re.compile(r"^(?:al-|el-|d['’]|l['’]|o['’]|mac(?=.{4})|mc)"), re.compile(r"[-\s]"), re.compile(r"\d\s$")
_STEP = re.compile(r"\w*[^\w]?")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool | None:
    """Whether the check digits agree; None if the kind has none."""
    digits = re.sub(r"\D", "", text)
    if kind == "digits15":
        body = re.sub(r"[^0-9A-Za-z]", "", text).upper().replace("2A", "19").replace("2B", "18")
        return 97 - int(body[:13]) % 97 == int(body[13:15])
    if kind == "letter23":
        body = re.sub(r"[^0-9A-Za-z]", "", text).upper()
        first = {"X": "0", "Y": "1", "Z": "2"}.get(body[0])
        number = (first + body[1:-1]) if first is not None else body[:-1]
        return len(number) == 8 and number.isdigit() and _LETTERS23[int(number) % 23] == body[-1]
    if kind == "card":
        return _luhn(digits)
    if kind == "digits11":
        product = 10
        for d in digits[:10]:
            s = (int(d) + product) % 10 or 10
            product = s * 2 % 11
        return (11 - product) % 10 == int(digits[10])
    return None


class Finder:
    """Finds spans by patterns, checks and context; given and family hold the lexicon in lower case."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.likely: dict[tuple[bool, str], bool] = {}
        self.flags: dict[str, int] = {}
        self.parts = {}
        for kind, lexicon in ((True, given), (False, family)):
            # heads and tails that at least three of the lexicon's words share: names it lacks are often built of them
            heads = Counter(w[:n] for w in lexicon for n in range(3, len(w) - 1))
            tails = Counter(w[n:] for w in lexicon for n in range(3, len(w) - 1))
            self.parts[kind] = {h for h, n in heads.items() if n >= 3}, {t for t, n in tails.items() if n >= 3}
        self.vague = {w for w in given | family if w in _PLACE_WORDS or w in ("may", "mark", "will", "grace", "faith", "hope", "rose")}

    def resembles(self, word: str, is_given: bool) -> bool:
        """Whether word, in lower case, is a head and a tail of the lexicon's names put together."""
        key = (is_given, word)
        if key not in self.likely:
            if len(self.likely) > 500_000:
                self.likely.clear()
            heads, tails = self.parts[is_given]
            self.likely[key] = any(word[:n] in heads and word[n:] in tails for n in range(3, len(word) - 1))
        return self.likely[key]

    def _flag(self, word: str) -> int:
        """What a word, as it stands in a text, may be part of."""
        w = word.lower()
        named = w in self.given or w in self.family or self.resembles(w, True) or self.resembles(w, False)
        for head in ("mac", "mc"):
            named = named or w.startswith(head) and len(w) > len(head) + 2 and (w[len(head) :] in self.family or self.resembles(w[len(head) :], False))
        return (
            named * _NAME | (w in _CUE_WORDS) * _CUE | (w in _AT_WORDS) * _AT_WORD | (w in _AFTER_WORDS) * _AFTER_WORD | w.endswith(_GERMAN_ENDS) * _GERMAN
            | (w in _BEFORE_WORDS) * _BEFORE_WORD | w.startswith(("sok", "cad", "bulv")) * _TURKISH
        )

    def _flagged(self, text: str) -> list[tuple[int, int, int]]:
        """(flags, start, end) of the words of a text that may be part of something. One pass and one look-up a word for all kinds together."""
        flags, out = self.flags, []
        if len(flags) > 500_000:
            flags.clear()
        for m in _WORD.finditer(text):
            word = m.group()
            f = flags.get(word)
            if f is None:
                f = flags[word] = self._flag(word)
            if f:
                out.append((f, m.start(), m.end()))
        return out

    def emails(self, text: str, words: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        signs = [(a, b) for f, a, b in words if f & _AT_WORD]
        at = text.find("@")
        if at >= 0:
            for m in _EMAIL.finditer(text):
                yield "email", m.start(), m.end(), 3.0
        while at >= 0:
            signs.append((at, at + 1))
            at = text.find("@", at + 1)
        done = -1
        for a, b in sorted(signs):
            if a <= done or not _AT_SIGN.match(text, a - 1) or not _HOST.match(text, b):
                continue
            # the stretch in which an address around this sign may lie grows until what is found there doesn't go on beyond its edges
            reach = 80
            while True:
                low, high = max(0, a - reach), min(len(text), b + reach)
                while low and not text[low - 1].isspace():
                    low -= 1
                while high < len(text) and not text[high].isspace():
                    high += 1
                at, m = low, None
                while (m := _SPOKEN.search(text, at, high)) and m.end(1) <= a:  # an earlier sign's; this one's may begin within it
                    at = _STEP.match(text, m.start()).end()
                if m and m.start(1) > a:
                    m = None
                start, end = (m.start(), m.end()) if m else (low, high)
                if (low == 0 or not _DOT_BEFORE.search(text, max(0, start - 24), start)) and (high == len(text) or not _DOT_BEHIND.match(text, end)):
                    break
                reach *= 4
            if m:
                start, found = m.start(), m.group()
                last = re.split(r"\W+", found)[-1].lower()
                bare = m.group(1).strip().lower() in ("at", "arroba", "arobase", "@")
                written = bool(re.search(r"(?i)[\s(\[](?:dot|punkt|punto)[\s)\]]", found[m.end(1) - start :]))
                if last in _TOP and (written or not bare):
                    done = m.end()
                    yield "email", start, m.end(), 2.5
                elif last in _TOP and re.search(r"(?i)mailto:$|contact|reply", text[max(0, start - 20) : start]):
                    done = m.end()
                    yield "email", start, m.end(), 1.5

    @staticmethod
    def _numbered(text: str) -> list[tuple[int, int]]:
        """Stretches around six digits or more; a number has at most letters and signs besides, all within the margins."""
        out: list[tuple[int, int]] = []
        for m in _MANY_DIGITS.finditer(text):
            low, high = max(0, m.start() - 16), m.end() + 6
            if out and low <= out[-1][1]:
                out[-1] = out[-1][0], high
            else:
                out.append((low, high))
        return out

    def phones(self, text: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
        for i, pattern, place in ((i, p, x) for x in places for i, p in enumerate(_PHONES)):
            for m in pattern.finditer(text, *place):
                digits = re.sub(r"\D", "", m.group())
                if not 8 <= len(digits) <= 15:
                    continue
                near = bool(_PHONE_NEAR.search(text[max(0, m.start() - NEAR) : m.start()]) or _PHONE_NEAR.search(text[m.end() : m.end() + 12]))
                score = (1.5, 1.5, 1.2, 1.0, 0.5)[i] + 1.0 * near
                if _ID_NEAR.search(text[max(0, m.start() - 24) : m.start()]) and not near and not m.group().startswith(("+", "(")):
                    score -= 1.0
                if _NOT_PERSON.search(text[max(0, m.start() - 14) : m.start()]):
                    score -= 1.5
                yield "phone", m.start(), m.end(), score

    def numbers(self, text: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
        for kind, pattern, place in ((k, p, x) for x in places for k, p in _IDS):
            for m in pattern.finditer(text, *place):
                near = bool(_ID_NEAR.search(text[max(0, m.start() - NEAR) : m.start()]) or _ID_NEAR.search(text[m.end() : m.end() + NEAR // 2]))
                score = {"digits9": 1.0, "insurance": 1.2, "digits11": 0.2, "digits15": 0.6, "letter23": 0.6, "card": -0.5, "coded": 0.0, "plain": -0.8}[kind] + 1.0 * near
                right = _valid(kind, m.group())
                if right is not None:
                    score += 0.6 if right else -0.4
                if kind == "digits11" and " " in m.group():
                    score += 0.6
                if _NOT_PERSON.search(text[max(0, m.start() - 14) : m.start()]) or re.match(r"(?i) (?:overflows|matched)", text[m.end() :]):
                    score -= 2.0
                yield "id_number", m.start(), m.end(), score

    def addresses(self, text: str, words: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Each pattern is tried only where a word it needs stands: at the number some words before a street's kind, at a street's own beginning."""
        after, german, french, spanish, turkish = (p for p, _ in _ADDRESSES)
        tried: set[tuple[re.Pattern, int]] = set()
        turks = False
        for f, a, b in words:
            starts: list[tuple[re.Pattern, int]] = []
            if f & _AFTER_WORD:
                at, numbers = a, []
                for _ in range(6):  # back over the name's words and an affix to the number
                    while at and text[at - 1] == " ":
                        at -= 1
                    while at and not text[at - 1].isspace():
                        at -= 1
                        if text[at].isdigit():
                            numbers.append(at)
                    if at == 0 or text[at - 1] != " ":
                        break
                starts = [(after, x) for x in reversed(numbers)]
            if f & _GERMAN:
                at = a
                while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
                    at -= 1
                starts.append((german, at))
            if f & _BEFORE_WORD:
                starts.append((spanish, a))
                starts += [(french, x) for x in range(max(0, a - 16), a) if text[x].isdigit()]
            turks |= bool(f & _TURKISH)
            for pattern, at in starts:
                if (pattern, at) not in tried:
                    tried.add((pattern, at))
                    if m := pattern.match(text, at):
                        yield "address", m.start(), m.end(), 1.0
        if turks:
            for m in turkish.finditer(text):
                yield "address", m.start(), m.end(), 1.0

    def _known(self, word: str, lexicon: set[str]) -> float:
        parts = [p for p in _BETWEEN.split(_HEADS.sub("", word.lower())) if len(p) > 1]
        if not parts:
            return 0.0
        known = [p for p in parts if p in lexicon]
        if known:
            return 0.3 if all(k in self.vague for k in known) else 1.0
        return 0.8 if any(self.resembles(p, lexicon is self.given) for p in parts) else 0.0

    @staticmethod
    def _begins(text: str, at: int) -> int:
        """Where a name that at lies in can begin at the earliest: some words before, and as long as those are capitals, initials or short ones, of the same line."""
        line = text.rfind("\n", 0, at) + 1
        low = max(line, at - 48)
        while low > line:
            cut = text.rfind(" ", line, low) + 1 or line
            if low - cut > 200 or not (text[low - 1] != " " or text[cut].isupper() or low - cut <= 4):
                break
            low = max(line, cut - 1) if cut > line else line
        return low

    def _stretches(self, text: str, words: list[tuple[int, int, int]]) -> list[list[int]]:
        """[start, end, has a known word in small letters] of what lies around known words and strong cues."""
        hits = [(a, b, text[a].islower()) for f, a, b in words if f & _NAME]
        cues = [(a, b) for f, a, b in words if f & _CUE and (text[a:b].lower() not in _LINKS or _LINKED.fullmatch(text[text.rfind(" ", 0, max(0, a - 1)) + 1 : max(0, a - 1)]))]
        at = text.find("@")
        while at >= 0:
            hits.append((at + 1, at + 1, False))
            at = text.find("@", at + 1)
        hits += [(m.end(), m.end(), False) for a, b in cues for m in _CUES.finditer(text, max(0, a - 20), b + 10)]
        out: list[list[int]] = []
        for a, b, small in sorted(hits):
            if out and a - 48 <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b + 64)
                out[-1][2] |= small
            else:
                out.append([self._begins(text, a), b + 64, small])
        return out

    def names(self, text: str, words: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        for low, high, small in self._stretches(text, words):
            while high < len(text) and text[high - 1] != "\n" and (text[high - 1].isalpha() or text[high - 1] in " -'’" and text[high].isupper()):
                high += 1  # a name isn't cut off at a stretch's end
            comma, capitals = text.find(",", low, high) >= 0, bool(_TWO_CAPITALS.search(text, low, high))
            for shape, pattern in _NAMES:
                if shape.endswith("last") and not comma or shape == "lastcaps" and not (comma and capitals) or shape == "caps" and not capitals or shape.startswith("low") and not small:
                    continue
                yield from self._scored(text, shape, pattern, low, high)

    def _scored(self, text: str, shape: str, pattern: re.Pattern, low: int, high: int) -> Iterator[tuple[str, int, int, float]]:
        at = low
        while m := pattern.search(text, at, high):
            at = _STEP.match(text, m.start()).end()
            if shape.startswith("low") and not any(self.flags.get(w, 0) & _NAME for w in _WORD.findall(m.group())):
                continue
            start, end, g, f = m.start(), m.end(), m.group("g"), m.group("f")
            if "\n" in m.group("gap") or "\n" in m.group():
                continue
            if g.lower().rstrip(".") in _TITLES and len(g.rstrip(".")) > 1 or g.lower() in _PLACE_WORDS or f.split()[-1].lower() in _PLACE_WORDS and f.split()[-1].lower() not in self.family:
                continue
            initial = g.endswith(".")
            given, family = (0.0 if initial else self._known(g, self.given)), self._known(_PARTICLES.sub("", f), self.family)
            before, after = text[max(0, start - 32) : start], text[end : end + 24]
            strong = bool(_CUE_STRONG.search(before)) and not (initial and "." not in g)
            cue = strong or bool(_CUE_BEFORE.search(before))
            follow = bool(_CUE_AFTER.search(after))
            alone = (start == 0 or text[start - 1] == "\n") and (end == len(text) or text[end] in "\n.;,")
            score = 0.9 * given + 0.9 * family + 0.5 * cue + 0.4 * strong + 0.3 * follow + 0.1 * alone
            if shape.startswith("low"):
                if given + family < (1.6 if not strong else 0.8) and not (initial and family >= 0.8 and cue):
                    continue
                score -= 0.5
            if initial and family < 0.8 and not cue:
                continue
            if initial:
                score += 0.2
            if _PLACE_AFTER.match(after):
                score -= 1.5
            if given + family < 0.8 and not strong:
                continue
            if given + family == 0 and not follow:
                score -= 0.3
            if _NUMBERED.search(before) and not follow and not before.endswith(("; ", "| ")):
                score -= 0.8
            yield "name", start, end, score

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every span that counts, in order of place; where spans overlap an e-mail stays before an address, that before numbers and those before names; of one rank the higher score, then the longer, then the earlier."""
        if not text:
            return []
        words, places = self._flagged(text), self._numbered(text)
        spans = [*self.emails(text, words), *self.phones(text, places), *self.numbers(text, places), *self.addresses(text, words), *self.names(text, words)]
        rank = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 3}
        spans = sorted((s for s in spans if s[3] >= CUTOFF), key=lambda s: (rank[s[0]], -s[3], s[1] - s[2], s[1]))
        kept: list[tuple[str, int, int]] = []
        taken = bytearray(len(text))
        for kind, start, end, _ in spans:
            if not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                kept.append((kind, start, end))
        return sorted(kept, key=lambda s: s[1])

    def redact(self, text: str | None) -> str | None:
        """text with each span replaced by its kind in brackets; all else stays as it is."""
        if not text:
            return text
        out, at = [], 0
        for kind, start, end in self.find(text):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join(out) + text[at:]


def _finder(lexicon: DataFrame) -> tuple[set[str], set[str]]:
    """The lexicon, a small table by its nature; checked, as it goes to every task."""
    rows = lexicon.where("lexeme is not null").select(F.lower(F.trim("lexeme")).alias("w"), F.lower(F.trim("lexeme_kind")).alias("k")).distinct().limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("a lexicon of over a million words doesn't fit into every task")
    return {r["w"] for r in rows if r["k"] == "given"}, {r["w"] for r in rows if r["k"] == "family"}


def found(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, found_text): each different piece of personal information of a document, as it stands in text.

    Null, empty and blank texts have none. Texts are searched whole. No shuffle: a document's pieces are made distinct where it is read.
    """
    ship(documents.sparkSession)
    given, family = _finder(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("pii_kind", pa.string()), ("found_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, family)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += dict.fromkeys((key, kind, text[a:b]) for kind, a, b in finder.find(text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, pii_kind string, found_text string")


def redacted(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text): every document with its personal information replaced by typed placeholders; null stays null."""
    ship(documents.sparkSession)
    given, family = _finder(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, family)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([finder.redact(t) for t in batch.column(1).to_pylist()], pa.string())], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")
