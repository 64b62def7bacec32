"""Features of an answer from which the labelling functions of defects vote."""

from __future__ import annotations

import re
import unicodedata

#: Tags an answer may be wrapped in.
TAGS = ("scratch_pad", "relevant_tables", "final_answer", "sql_code")

_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_FENCE = re.compile(r"```[A-Za-z]*")
_CLOSED = re.compile(r"(?:</[A-Za-z][\w-]*>|```)\s*$")
_STATEMENT = re.compile(r"(?is)\b(?:select\s+(?:distinct\s+)?(?=[^.?!]{1,400})(?:[\w`\"\[.(*]|case\b))|(?<![\w])with\s+\w+\s+as\s*\(")
_SELECT, _FROM = re.compile(r"(?i)\bselect\b"), re.compile(r"(?i)\bfrom\s+[\w`\"\[]")
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\w+|[<>=!]+|[^\s\w]")
#: Quoted values of any length; a single quote begins one only where no word ends, so that an apostrophe doesn't.
_QUOTED = re.compile(r"(?<!\w)'[^'\n]+'(?!\w)|\"[^\"\n]+\"|`[^`\n]+`|«[^»\n]*»|“[^”\n]*”|「[^」\n]*」|‘[^’\n]*’")
_WORDS = re.compile(r"[^\W\d_]+")

#: Frequent function words; of the other languages those that English prose has no use for.
ENGLISH = frozenset(
    "the a an of to in is are was were be been that this these those for with without on by at from as and or not no it its i we you my your our they he she do does did can cannot will would "
    "should may might must have has had all any each every so if when where which who what how there here before after above below than then into about against between only just also because since but "
    "however please sorry thanks thank let me one two under over kept left rows query".split()
)
FOREIGN = frozenset(
    "der die das den dem des ein eine einen einem und oder nicht ist sind wird werden für mit auf aus von zu zur zum im ich wir sie es auch nur wenn dass bei über nach alle keine "
    "el la los las un una unos unas y o no es son se de del al en con por para que su sus lo como más pero todas todos esta este "
    "le les des du et ou est sont une pour dans sur avec ce cette ces qui je nous vous il elle on ne pas plus tous toutes puis leur aucune "
    "il lo gli uno che di con per non si come più sono della delle dei nel nella poi prima "
    "os as um uma e ou são não com por isso na no nas nos pela pelo dos das depois "
    "i w z na do nie się jest są oraz który które przez dla po od potem więc tylko "
    "ve bir bu için ile de da ki olarak sonra önce yalnızca bütün "
    "het een en van niet zijn wordt voor met op naar ook alleen och att det som för med på inte är av till og ikke er af".split()
) - ENGLISH

#: General wording by which an answer declines; only hints, as the label model also goes by an answer's form.
DECLINES = re.compile(
    r"(?i)\b(?:sorry|apolog\w+|regret\w*|unfortunately|afraid|cannot|can ?not|can['’]t|won['’]t|unable|not able|refus\w+|declin\w+|den(?:y|ied)|not (?:allowed|permitted|possible|comfortable|authori[sz]ed|going to)|"
    r"(?:would|will|shall|must|do|does|may) not|rather not|polic(?:y|ies)|guidelines?|permissions?|restricted|private|protected|sensitive|blocked|off limits|prevents?|no (?:answer|statement|access))\b"
)

#: Words after which a statement can't end.
_OPEN_WORDS = frozenset(
    "select distinct from where and or on by as join inner left right outer full cross limit order group having between in not is like case when then else cast with union except intersect all offset "
    "over partition using exists".split()
)
_OPEN_SIGNS = frozenset(["=", "<", ">", "<=", ">=", "!=", "<>", "!", ",", ".", "(", "+", "-", "/", "%", "|", "'", '"', "`", "[", "{"])


def bare(text: str) -> str:
    """Letters and digits that are left without markup, punctuation, white space and invisible characters."""
    text = _FENCE.sub(" ", _TAG.sub(" ", text))
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def statement_of(text: str) -> str | None:
    """The last statement an answer began, up to its closing tag, fence or the end; None if it began none."""
    at = None
    for match in _STATEMENT.finditer(text):
        at = match.start()
    return None if at is None else text[at:]


def full_statement(text: str) -> bool:
    """Whether a SELECT is followed, however far on, by FROM and a name."""
    begin = _SELECT.search(text)
    return bool(begin and _FROM.search(text, begin.end() + 1))


def prose_of(text: str) -> str:
    """An answer without statements, markup and quoted values."""
    text = re.sub(r"(?is)```(?:sql)?.*?(?:```|$)", " ", text)
    text = re.sub(r"(?is)<(sql_code|relevant_tables)>.*?(?:</\1>|$)", " ", text)
    text = re.sub(r"(?is)\bcall:\w+\{.*?(?:\}|$)", " ", text)
    text = re.sub(r"(?s)\b(?:select|SELECT|Select)\s.*?(?:;|(?=</)|$)", " ", text)
    return _TAG.sub(" ", _QUOTED.sub(" ", text))


def closed(text: str) -> int:
    """1 if every tag and fence begun is finished, 0 if there are none, -1 if one is open."""
    opened = len(re.findall("```", text))
    if opened % 2:
        return -1
    any_tag = opened > 0
    for tag in TAGS:
        starts, ends = text.count(f"<{tag}>"), text.count(f"</{tag}>")
        if starts > ends:
            return -1
        any_tag |= starts > 0
    if re.search(r"</?[A-Za-z_]{0,20}$|<$", text.rstrip()) and not re.search(r"<\s*$", _FENCE.sub("", text)):
        return -1
    return 1 if any_tag else 0


def statement_ends(sql: str, gold: str | None) -> tuple[int, int]:
    """(grammar, names): grammar is -1 if the statement's last words can't be its end, else 1. names is -1 if its last name is only the beginning of one
    that the reference statement or the statement itself has, or an alias it uses is never declared; 1 if it is known there; else 0."""
    sql = sql.strip().rstrip(";").rstrip()
    for mark in "'\"`":
        if sql.count(mark) % 2:
            return -1, 0
    tokens = _TOKEN.findall(sql)
    if not tokens:
        return -1, 0
    low = [t.lower() for t in tokens]
    if low.count("(") != low.count(")") or low[-1] in _OPEN_WORDS or low[-1] in _OPEN_SIGNS or low[-1].strip("<>=!") == "":
        return -1, 0
    if "from" not in low:
        return -1, 0
    names = 0
    aliases = set(re.findall(r"(?i)\b(?:from|join)\s+[\w`\"\[\]]+\s+(?:as\s+)?(\w+)", sql)) | set(re.findall(r"(?i)\b(?:from|join)\s+[`\"\[]?(\w+)", sql))
    used = set(re.findall(r"(?<![\w.'\"`])([A-Za-z]\w*)\s*\.\s*[`\"\[]?[A-Za-z_]", re.sub(r"'[^']*'|\"[^\"]*\"", " ", sql)))
    if {u.lower() for u in used} - {a.lower() for a in aliases}:
        return -1, -1
    # the clause that the end lies in
    last = max((i for i, t in enumerate(low) if t in ("where", "on", "and", "or", "having", "by", "from", "join", "select", "limit", "as")), default=-1)
    clause, rest = (low[last], tokens[last + 1 :]) if last >= 0 else ("", tokens)
    text = " ".join(rest).lower()
    if clause in ("where", "on", "and", "or", "having"):
        between = clause == "and" and "between" in low[max(0, last - 3) : last]
        if not between and not re.search(r"[<>=]|\bis (?:not )?null\b|\blike\s+\S|\bin\s*\(|\bbetween\b|\bexists\b", text):
            return -1, 0
        if re.search(r"\bis( not)?$", text):
            return -1, 0
    if clause == "join" and "on" not in low[last:]:
        return -1, 0
    if clause in ("as",) and low[last - 2 : last - 1] == ["join"]:
        return -1, 0
    if clause == "limit" and not re.fullmatch(r"\d+( , \d+| offset \d+)?", text):
        return -1, 0
    tail = tokens[-1]
    if re.fullmatch(r"[A-Za-z_]\w*", tail) and low[-1] not in ("asc", "desc", "null", "end", "last", "first"):
        known = {t.lower().strip("`\"[]") for t in _TOKEN.findall(gold or "")} | {t.strip("`\"[]") for t in low[:-1]}
        if low[-1] in known or low[-1] in {a.lower() for a in aliases} and clause not in ("by",):
            names = 1
        elif any(k.startswith(low[-1]) for k in known | {"asc", "desc", "limit", "order", "group", "having", "where", "inner"}):
            names = -1
        elif clause == "by" and len(tokens) >= 2 and tokens[-2] not in (",", ".") and low[-2] != "by":
            names = -1  # what follows a sort key is ASC, DESC or a clause
    return 1, names


def features(text: str | None, pred_sql: str | None, gold_sql: str | None) -> dict:
    """What the labelling functions look at; without any text all are as for an empty one."""
    text = text or ""
    rest = bare(text)
    statement = statement_of(text)
    full = bool(statement and full_statement(text))
    prose = prose_of(text) if rest else ""
    words = [w.lower() for w in _WORDS.findall(prose)]
    letters = sum(map(len, words))
    latin = sum(len(w) for w in words if "a" <= unicodedata.normalize("NFD", w[0])[0] <= "z" or w[0] in "øłđıæœß")
    english, foreign = sum(w in ENGLISH for w in words), sum(w in FOREIGN for w in words)
    ends, names = statement_ends(re.split(r"</|```", statement)[0], gold_sql) if statement else (0, 0)
    stripped = text.rstrip()
    # prose after the last closed part, or the whole text if there is no statement
    tail = re.split(r"```|</[A-Za-z_]+>", stripped)[-1].strip() if ("```" in stripped or "</" in stripped) else ("" if statement else stripped)
    return {
        "empty": not rest, "statement": statement is not None, "full": full, "closed": closed(text), "ends": ends, "names": names,
        "foreign_script": letters >= 4 and latin < 0.7 * letters, "words": len(words), "english": english, "foreign": foreign,
        "declines": bool(DECLINES.search(prose)) if not statement else False, "tail_open": bool(tail) and not re.search(r"[.!?。！？…\")\]}>;'”»`]$", tail) and bool(re.search(r"\w", tail)),
        "colon": stripped.endswith((":", "：")), "sql_word": bool(pred_sql and re.search(r"\w", pred_sql)), "trailing": tail,
    }
