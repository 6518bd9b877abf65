"""Personal information in free text: bootstrapped contextual extraction and typed placeholders.

Seeds are entities in unmistakable forms (``SEEDS``: a plain mailbox, a number with a country code, national identity numbers, a numbered
street with its type in full, a ``first.last`` mailbox that names its owner). They induce lexical patterns, the words in front of an instance.
Spark scores the graph of patterns, instances and forms over the whole corpus, round by round, for mailboxes, phones, identity numbers and
street addresses alike: a pattern counts as far as its instances are known, an instance as far as its patterns are, and a form (a veiled
mailbox, a national number, a foreign street) counts as far as its instances stand behind confident patterns. What is found so confirms further
patterns, until nothing changes. No form but the seeds is taken for personal information unless the corpus has taught it, or a pattern in front does.
Name pairs discover further given and family names in the same way.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.plans.scratch import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Kinds and forms that prove themselves. Every country's identity number stands behind words of its own, so each of these forms is a seed.
SEEDS = {("email", "plain"), ("phone", "country"), ("street_address", "full"), *(("id_number", form) for form in ("social", "insurance", "passport", "tax"))}
ROUNDS = 8  #: most rounds of pattern, instance and form scoring; they end when nothing changes
ACCEPT = 0.25  #: of the different instances of a form that have to stand behind confident patterns of its kind, from which on the form counts
NAME_ROUNDS = 3  #: rounds along the graph of name pairs
CONFIDENCE = 0.8  #: of a pattern that may discover instances
SUPPORT = 3  #: known instances that such a pattern has at least
HALF = 0.5  #: of all instances of a pattern without enough seeds that have to be known
LEXICON = 200_000  #: facts (names, words, patterns, forms) up to which all are sent to every task; more are joined with what each block of texts asks for
BLOCK = 10_000  #: texts of such a block
RARE = 5e-7  #: of all tokens of the corpus, from which on (and from 5 on) a word is known

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_LOCAL = r"[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![a-z0-9._%+/@-])(?:"
    rf"(?P<plain>{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}})"
    rf"|(?P<veiled>{_LOCAL}(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,}})"
    rf"|(?P<spoken>{_LOCAL}\sat\s{_LABEL}(?:\sdot\s{_LABEL})*\sdot\s[a-z]{{2,}})"
    rf"|(?P<shouted>(?-i:{_LOCAL}\sAT\s{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}}))"
    rf"|(?P<worded>[a-z0-9]+[._+][a-z0-9._+]*[a-z0-9]\sat\s{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}})"
    rf")(?![a-z0-9])",
    re.I,
)
_EXT = r"(?:[ ,]*(?:ext\.?|extension|x)\s*\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<country>(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4})"
    r"|(?P<area>\(\d{3}\)[ .-]?\d{3}[ .-]\d{4})"
    r"|(?P<ten>(?:1[ .-])?\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4})"
    r"|(?P<mobile>07\d{3}[ .-]?\d{3}[ .-]?\d{3})"
    r"|(?P<zero>0\d{2,4}[ /-]\d{4,8}(?:-\d{1,4})?)"
    r")" + _EXT + r"(?![\w/-]|\.\d)",
    re.I,
)
_ID = re.compile(
    r"(?<![\w./-])(?:"
    r"(?P<social>\d{3}(?P<gap>[- ])\d{2}(?P=gap)\d{4})"
    r"|(?P<insurance>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D])"
    r"|(?P<passport>[A-Z]\d\d[A-Z]\d{5})"
    r"|(?P<tax>\d\d/\d{3}/\d{5})"
    r")(?![\w/-]|\.\d)"
)
#: Forms that prove nothing by themselves: a pattern in front has to.
_LOOSE = re.compile(r"(?<![\w./+-])(?:[A-Z]{1,2}[ -]?)?\d(?:[ ./-]?[A-Za-z]?\d){6,13}(?![\w/-]|\.\d)")
_TYPES = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Boulevard|Blvd|Terrace|Square|Sq|Crescent"
_TYPE_LIST = [f" {t}" for t in _TYPES.split("|") if len(t) > 3 or t == "Ave"]
_STREET = f"(?:{_TYPES}|{_TYPES.upper()})"
_UNIT = r"(?:Apt|APT|Apartment|Flat|FLAT|Unit|Suite|Ste)\.? ?#?\w{1,5}"
_TOWN = r"(?:,\s{1,2}(?:\d{4,5} )?[A-Z][\w-]+(?: \d{4,6}\b)?)?"
#: From a house number on. Group 1: the last word of the street's name.
_NUMBERED = re.compile(rf"\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:[A-Z][\w'-]+ ){{0,2}}([A-Z][\w'-]+) ({_STREET})\b\.?(?:,? {_UNIT}\b)?{_TOWN}")
_NUMBERED_LOW = re.compile(rf"\d{{1,5}}[a-z]? ([a-z][\w'-]+) (?:{_TYPES.lower()})\b\.?")
_UNIT_BEFORE = re.compile(rf"{_UNIT},? $")
#: A street's name up to its number, where the number follows.
_NUMBER_LAST = re.compile(r"(?<![\w-])[^\W\d_][\w-]*?(?:er )?(?:str\.|straße|strasse|weg|allee|platz|gasse)\s*$", re.I)
_LED = re.compile(r"(?<![\w-])(?:calle|avenida|avda\.?|plaza|paseo|camino|rue|via)\s+(?:(?:de|del|la|las|los|el|du|des)\s+)*[^\W\d_][\w-]*(?:\s+[A-ZÁÉÍÓÚÑ][\w-]*)?,?\s*$", re.I)
_LEADING = ("calle", "avenida", "avda", "plaza", "paseo", "camino", "rue", "via")
_LEADS = re.compile(r"\b(?:calle|avenida|avda|plaza|paseo|camino|rue|via)\b", re.I)
_AFTER_NUMBER = re.compile(r"\d{1,4}(?: ?[a-z]\b)?(?:,\s{1,2}\d{1,2}º(?: ?[A-Z]\b)?)?(?:(?:,\s{1,2}|\s+in\s+)\d{5}\s+[A-Z][\w-]+)?")
_STREET_ENDS = ("str.", "straße", "strasse", "weg", "allee", "platz", "gasse")
_BARE_STREET = re.compile(rf"(?<!\d )(?<!\d[a-z] )\b([A-Z][\w'-]+) {_STREET}\b")
_HOUSE = re.compile(r"(?<![\w/.,+-])\d{1,5}(?![\d/])")
_MANY_DIGITS = re.compile(r"\d(?:[ ()/.-]{0,2}[A-Za-z]?\d){5,}")
_BRACKETED = ("(at", "[at", "{at", "( at", "[ at", "{ at")
_PLAIN_AT = re.compile(r"[._+]\w+ at \w")
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PAIR = re.compile(r"(?<![\w@/.+-])([A-Z][a-z]+)(?:,? (?:[A-Z]\. )?|, )([A-Z][a-z]{2,})(?:-([A-Z][a-z]{2,}))?(?![\w@]|[.+-]\w)")
_OWNER = re.compile(r"^([a-z]{2,})[._]([a-z]{3,})$")
_DOT_AFTER = re.compile(r"[a-z0-9-]+\sdot\s", re.I)


def _back(text: str, at: int, n: int) -> int:
    """Where the last n tokens before a place begin, however long they are."""
    while n and at > 0:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        blank = text.rfind(" ", 0, at)
        at = max(blank, text.rfind("\n", blank + 1, at), text.rfind("\t", blank + 1, at)) + 1
        n -= 1
    return at


def _before(text: str, start: int) -> str:
    """The pattern of an instance: the last two words in front, in the same line."""
    line = text[_back(text, start, 3) : start].rsplit("\n", 1)[-1]
    return " ".join(w.lower() for w in _WORDS.findall(line)[-2:])


def _shape(instance: str) -> str:
    return re.sub(r"\d", "9", re.sub("[A-Za-z]", "a", instance))


def _key(instance: str) -> str:
    """The same for all spellings of a number."""
    return re.sub(r"[\W_]", "", instance).upper()


def _streets(text: str):
    """(start, end, name, form) of street addresses with a house number in front or behind; lower-cased name, with a dot if the text has it in lower case."""
    low = text.lower()
    led = _LEADS.search(text) if any(x in low for x in _LEADING) else None
    for h in _HOUSE.finditer(text):
        a = h.start()
        m = _NUMBERED.match(text, a)
        name, form = (m[1].lower(), "full" if len(m[2]) > 4 else "short") if m else ("", "")
        if not m:
            m = _NUMBERED_LOW.match(text, a)
            name, form = ("." + m[1], "lower") if m else ("", "")
        if m:
            unit = _UNIT_BEFORE.search(text, max(0, a - 20), a)
            yield (unit.start() if unit else a), m.end(), name, form
            continue
        end = text[max(0, a - 8) : a].rstrip().lower()
        front = _NUMBER_LAST.search(text[_back(text, a, 2) : a]) if end.endswith(_STREET_ENDS) else None
        form = "number last"
        if front is None and led and led.end() < a and text[a - 1].isspace() and _LEADS.search(text, begin := _back(text, a, 8), a):
            front, form = _LED.search(text[begin:a]), "led"
        elif front and not (front[0][0].isupper() or "str" in front[0].lower()):
            front = None
        if front:
            yield a - len(front[0]), _AFTER_NUMBER.match(text, a).end(), "", form


def _mailbox(text: str, at, last: int):
    """The mailbox around an at-sign, or None; it begins in the token in front of it."""
    begin = max(last, _back(text, at.start(), 1), 0)
    for a in range(begin, at.start()):
        m = _EMAIL.match(text, a)
        if m:
            return m if m.end() > at.end() else None
    return None


def _spans(text: str, streets=None):
    """Spans of forms, (start, end, kind, form), not overlapping, in the order emails, addresses, ids, phones.

    The costly forms are only tried around an at-sign or its spellings and around runs of digits. ``streets`` (good, bad) are
    the names of streets known to stand after numbers, and without them; a name in lower case has to be known.
    """
    taken: list[tuple[int, int, str, str]] = []

    def add(a, b, kind, form):
        if all(b <= s or e <= a for s, e, _, _ in taken):
            taken.append((a, b, kind, form))

    last = -1
    low = text.lower()
    for at in _AT.finditer(text) if "@" in low or " AT " in text or "dot" in low or any(x in low for x in _BRACKETED) or (" at " in low and _PLAIN_AT.search(low)) else ():
        if at[0][0].isspace() and not at[0].isupper() and not _DOT_AFTER.match(text, at.end()) and not re.search(r"\w[._+]\w", text[_back(text, at.start(), 1) : at.start()]):
            continue
        m = _mailbox(text, at, last)
        last = at.end()  # a mailbox holds one at-sign, so none begins before an earlier one
        if m:
            add(m.start(), m.end(), "email", m.lastgroup)
            last = m.end()
    for a, b, name, form in _streets(text):
        if streets is None or not name or (name[1:] in streets[0] if name[0] == "." else name not in streets[1]):
            add(a, b, "street_address", form)
    for d in _MANY_DIGITS.finditer(text):
        a, b = max(0, d.start() - 12), d.end() + 24
        for forms, kind in ((_ID, "id_number"), (_PHONE, "phone")):
            for m in forms.finditer(text, a, min(len(text), b)):
                add(m.start(), m.end(), kind, m.lastgroup if m.lastgroup != "gap" else next(n for n, v in m.groupdict().items() if v is not None))
    return taken


def _loose(text: str, spans):
    for d in _MANY_DIGITS.finditer(text):
        for m in _LOOSE.finditer(text, max(0, d.start() - 3), min(len(text), d.end() + 2)):
            if all(m.end() <= x[0] or x[1] <= m.start() for x in spans):
                yield m


@dataclass
class Knowledge:
    """What the corpus taught: names, words that are none, streets, patterns of two words and of one, shapes of numbers, instances that stand behind a pattern elsewhere, forms of a kind, and (pattern, shape) that announce something else."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    words: set[str] = field(default_factory=set)
    streets: tuple[set[str], set[str]] = field(default_factory=lambda: (set(), set()))
    patterns: dict[str, str] = field(default_factory=dict)
    last_words: dict[str, str] = field(default_factory=dict)
    shapes: dict[str, str] = field(default_factory=dict)
    against: set[tuple[str, str]] = field(default_factory=set)
    instances: dict[str, str] = field(default_factory=dict)
    forms: set[tuple[str, str]] = field(default_factory=set)
    table: DataFrame | None = None  #: all of this as (role, x, y), and the sets empty, where it is more than ``LEXICON``


def _told(rows) -> Knowledge:
    """Knowledge of facts (role, x, y)."""
    known = Knowledge()
    sets = {"given": known.given, "family": known.family, "word": known.words, "street": known.streets[0], "no street": known.streets[1]}
    kinds = {"pattern": known.patterns, "last word": known.last_words, "shape": known.shapes, "instance": known.instances}
    for role, x, y in rows:
        if role in sets:
            sets[role].add(x)
        elif role in kinds:
            kinds[role][x] = y
        elif role == "form":
            known.forms.add((x, y))
        else:
            known.against.add((x, y))
    return known


def _asked(text: str) -> set[str]:
    """Everything that ``find`` may look up for a text."""
    out = {*_TOKEN.findall(text.lower()), *(w.lower() for w in _TOKEN.findall(text)), *(name.lstrip(".") for _, _, name, _ in _streets(text)), *KINDS}
    for a, b, _, _ in _spans(text):
        out |= {_before(text, a), _key(text[a:b])}
    for m in _loose(text, ()):
        before = _before(text, m.start())
        out |= {before, before.rsplit(" ", 1)[-1], _shape(m[0]), _key(m[0])}
    return out


def observe(text: str, facts: Counter) -> list[tuple[int, int]]:
    """Count what a text shows: (role, x, y) facts about instances, patterns, streets and names. Returns the spans of mailboxes, whose parts are no words."""
    spans = _spans(text)
    for a, b, kind, form in spans:
        if kind == "email":
            m = _OWNER.match(re.split(r"[@\s\[({]", text[a:b].lower(), maxsplit=1)[0])
            if m:
                facts["owner", m[1], m[2]] += 1
        elif kind == "street_address":
            for _, _, name, _ in _streets(text[a:b]):
                facts["street", name.lstrip("."), ""] += 1
        role = f"seed {kind}" if (kind, form) in SEEDS else f"form {kind}|{form}"
        facts[role, _before(text, a), text[a:b]] += 1
    for m in _loose(text, spans):
        facts["loose", _before(text, m.start()), m[0]] += 1
    for m in _BARE_STREET.finditer(text) if any(t in text for t in _TYPE_LIST) else ():
        facts["no street", m[1].lower(), ""] += 1
    for m in _PAIR.finditer(text):
        if all(m.end() <= x[0] or x[1] <= m.start() for x in spans):
            inverted = "," in m[0][len(m[1]) : len(m[1]) + 2]
            for family in filter(None, (m[2], m[3])):
                x, y = (family, m[1]) if inverted else (m[1], family)
                facts["pair", x.lower(), y.lower()] += 1
    return [(a, b) for a, b, kind, _ in spans if kind == "email"]


def learn(texts: DataFrame) -> Knowledge:
    """Score the graph of patterns, instances and names of the column ``text``, over all rows; null texts show nothing."""

    def facts(batches):
        seen: Counter = Counter()
        tokens: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for a, b in observe(t, seen):
                        t = t[:a] + " " * (b - a) + t[b:]
                    tokens.update(_TOKEN.findall(t))
            if len(seen) + len(tokens) > 300_000:
                yield _facts(seen, tokens)
                seen, tokens = Counter(), Counter()
        yield _facts(seen, tokens)

    table = texts.select("text").mapInArrow(facts, "role string, x string, y string, n long").groupBy("role", "x", "y").agg(F.sum("n").alias("n"))
    table = cut(table)
    street = table.filter(F.col("role").isin("street", "no street")).groupBy("x").pivot("role", ["street", "no street"]).agg(F.sum("n")).na.fill(0)
    streets = street.select(F.when(F.col("street") > F.col("no street"), "street").otherwise("no street").alias("role"), "x", F.lit("").alias("y"))
    told = cut(_learn_patterns(table).unionByName(_learn_names(table)).unionByName(streets))
    if told.limit(LEXICON + 1).count() > LEXICON:
        return Knowledge(table=told)
    return _told(map(tuple, told.collect()))


def _learn_patterns(table: DataFrame) -> DataFrame:
    """Facts (role, x, y): patterns from seeds; then, in rounds, instances from patterns, forms from instances, and patterns from instances; shapes of loose numbers from confident patterns; last words of patterns, for such shapes only.

    A form is no evidence by itself: order numbers look like telephone numbers. It counts from ``SUPPORT`` different instances on that stand behind confident
    patterns of its kind, or are known from elsewhere, if they are ``ACCEPT`` of all. A pattern without enough seeds is confirmed by
    ``SUPPORT`` different known instances if they are the ``HALF`` of all its instances.
    """
    kinds = ("phone", "id_number", "email", "street_address")
    plain = F.when(F.col("role").endswith(" phone") | F.col("role").contains(" phone|"), F.regexp_replace("y", r"(?i)[ ,]*(?:ext\.?|extension|x)\s*\d{1,5}$", "")).otherwise(F.col("y"))
    facts = table.filter(F.col("role").startswith("seed ") | F.col("role").startswith("form ") | (F.col("role") == "loose"))
    facts = cut(facts.select("role", "x", "y", "n", F.upper(F.regexp_replace(plain, r"[^\p{L}\p{Nd}]", "")).alias("i")))
    every_seed = facts.filter(F.col("role").startswith("seed ")).select(F.substring("role", 6, 100).alias("kind"), "x", "i", "n")
    seeds = every_seed.filter("x <> ''")
    formed = facts.filter(F.col("role").startswith("form ")).select(F.substring_index(F.substring("role", 6, 100), "|", 1).alias("kind"), F.substring_index("role", "|", -1).alias("form"), "x", "i", "n")
    word = F.element_at(F.split("x", " "), -1)

    def of_kind(rows: DataFrame, key, count, least: int) -> DataFrame:
        """(p, kind) of the keys with ``least`` of a kind and ``CONFIDENCE`` of all kinds."""
        seen = rows.groupBy(key.alias("p")).pivot("kind", list(kinds)).agg(count).na.fill(0)
        every = sum((F.col(k) for k in kinds), F.lit(0))
        sure = [F.when((F.col(k) >= least) & (F.col(k) >= CONFIDENCE * every), F.lit(k)) for k in kinds]
        return seen.select("p", F.coalesce(*sure).alias("kind"), every.alias("known")).filter("kind IS NOT NULL")

    confident = cut(of_kind(seeds, F.col("x"), F.sum("n"), SUPPORT).select(F.col("p").alias("x"), "kind"))
    loose = facts.filter("role = 'loose'").select("x", F.regexp_replace(F.regexp_replace("y", "[A-Za-z]", "a"), r"\p{Nd}", "9").alias("y"), "i", "n", word.alias("p"))
    sure = cut(of_kind(every_seed, F.col("i"), F.sum("n"), 1).select(F.col("p").alias("i"), "kind"))
    stands = cut(facts.select("x", "i").distinct())
    of_all = stands.filter("x <> ''").groupBy("x").agg(F.count(F.lit(1)).alias("all"))
    of_form = formed.groupBy("kind", "form").agg(F.countDistinct("i").alias("all"))
    # last words alone, and patterns of a single seed, are weaker: they may confirm forms and shapes, but find nothing by themselves
    lastly = cut(of_kind(seeds, word, F.sum("n"), SUPPORT).select(F.col("p").alias("x"), "kind"))
    weak = cut(of_kind(seeds, F.col("x"), F.sum("n"), 1).select(F.col("p").alias("x"), "kind"))
    backed = formed.withColumn("w", word).join(lastly.withColumnRenamed("x", "w"), ["w", "kind"]).select("i", "kind", "form")
    backed = backed.unionByName(formed.join(weak, ["x", "kind"]).select("i", "kind", "form"))
    instances, forms = sure, formed.select("kind", "form").limit(0)
    for _ in range(ROUNDS):
        behind = loose.join(confident, "x").select("i", "kind", "n").unionByName(formed.join(confident, ["x", "kind"]).select("i", "kind", "n"))
        found = of_kind(behind, F.col("i"), F.sum("n"), 1).select(F.col("p").alias("i"), "kind")
        known = cut(sure.unionByName(found.join(sure, "i", "left_anti")))
        met = formed.join(known, ["i", "kind"]).select("i", "kind", "form").unionByName(backed).groupBy("kind", "form").agg(F.countDistinct("i").alias("known")).join(of_form, ["kind", "form"])
        grown = cut(met.filter((F.col("known") >= SUPPORT) & (F.col("known") >= ACCEPT * F.col("all"))).select("kind", "form").unionByName(forms).distinct())
        by_form = of_kind(formed.join(grown, ["kind", "form"]), F.col("i"), F.sum("n"), 1).select(F.col("p").alias("i"), "kind")
        instances = cut(known.unionByName(by_form.join(known, "i", "left_anti")))
        more = of_kind(stands.filter("x <> ''").join(confident, "x", "left_anti").join(instances, "i"), F.col("x"), F.count(F.lit(1)), SUPPORT)
        more = cut(more.withColumnRenamed("p", "x").join(of_all, "x").filter(F.col("known") >= HALF * F.col("all")).select("x", "kind"))
        still = grown.count() == forms.count() and not more.head(1)
        forms = grown
        if still:
            break
        confident = cut(confident.unionByName(more))
    elsewhere = loose.select("x", "i").unionByName(formed.join(forms, ["kind", "form"], "left_anti").select("x", "i")).join(confident, "x", "left_anti").select("i").distinct()
    instances = instances.join(elsewhere, "i", "left_semi").withColumnRenamed("i", "x")
    told = _facts_of("pattern", confident).unionByName(_facts_of("last word", lastly)).unionByName(_facts_of("instance", instances))
    told = told.unionByName(forms.select(F.lit("form").alias("role"), F.col("kind").alias("x"), F.col("form").alias("y")))
    # recurrent patterns in front of a form that no seed ever has, nor an instance found, announce something else
    sums = cut(loose.groupBy("x", "y", "p").agg(F.sum("n").alias("n")))
    telling = cut(seeds.select("x").unionByName(confident.select("x")).distinct())
    never = sums.filter((F.col("n") >= SUPPORT) & (F.col("x") != "")).join(telling, "x", "left_anti")
    lasts = sums.groupBy("p", "y").agg(F.sum("n").alias("n")).filter((F.col("n") >= SUPPORT) & (F.col("p") != ""))
    lasts = lasts.join(telling.select(word.alias("p")).distinct(), "p", "left_anti").select(F.col("p").alias("x"), "y")
    rest = sums.join(never.select("x", "y"), ["x", "y"], "left_anti").join(confident, "x", "left")
    shapes = rest.groupBy("y").pivot("kind", list(kinds)).agg(F.sum("n")).na.fill(0).join(rest.groupBy("y").agg(F.sum("n").alias("n")), "y")
    often = [F.when((F.col(k) >= SUPPORT) & (F.col(k) >= 0.3 * F.col("n")), F.lit(k)) for k in reversed(kinds)]
    shapes = shapes.select(F.col("y").alias("x"), F.coalesce(*often).alias("kind")).filter("kind IS NOT NULL")
    against = never.select("x", "y").unionByName(lasts).distinct().select(F.lit("against").alias("role"), "x", "y")
    return told.unionByName(_facts_of("shape", shapes)).unionByName(against)


def _facts_of(role: str, rows: DataFrame) -> DataFrame:
    """(role, x, y) of rows (x, kind)."""
    return rows.select(F.lit(role).alias("role"), "x", F.col("kind").alias("y"))


def _learn_names(table: DataFrame) -> DataFrame:
    """Facts (role, x, y) about names and words: pairs of a given and a family name, from owners of mailboxes outwards along the graph of pairs."""
    word = table.filter(F.col("role").isin("lower", "upper")).groupBy("x").agg(F.sum(F.when(F.col("role") == "lower", F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("n"))
    word = cut(word)
    common = word.filter((F.col("low") >= 0.5 * F.col("n")) & (F.col("n") >= 5)).select(F.col("x").alias("w"))
    owners = table.filter("role = 'owner'").select("x", "y")
    pairs = table.filter("role = 'pair'").select("x", "y")
    pairs = pairs.join(common, pairs.x == common.w, "left_anti").join(common, F.col("y") == common.w, "left_anti")
    paired = table.filter("role = 'pair'").select(F.explode(F.array("x", "y")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n2"))
    mostly = word.join(paired, word.x == paired.t).filter(F.col("n2") >= 0.25 * F.col("n")).select(F.col("t").alias("w2"))
    pairs = cut(pairs.join(mostly, pairs.y == mostly.w2, "left_semi"))
    given = cut(owners.groupBy("x").agg(F.countDistinct("y").alias("k")).filter("k >= 2").select(F.col("x").alias("g")))
    family = cut(owners.join(given, owners.x == given.g, "left_semi").select(F.col("y").alias("f")).distinct())
    for _ in range(NAME_ROUNDS):
        given = cut(pairs.join(family, pairs.y == family.f).groupBy("x").agg(F.countDistinct("y").alias("k")).filter(F.col("k") >= SUPPORT).select(F.col("x").alias("g")).unionByName(given).distinct())
        family = cut(pairs.join(given, pairs.x == given.g).select(F.col("y").alias("f")).unionByName(family).distinct())
    family = family.join(common, family.f == common.w, "left_anti")
    family = cut(family.join(given, family.f == given.g, "left_anti"))
    least = max(5.0, RARE * (word.agg(F.sum("n")).head()[0] or 0))
    words = word.filter(F.col("n") >= least).join(family, word.x == family.f, "left_anti").select("x")
    named = lambda role, rows: rows.toDF("x").filter("x IS NOT NULL").select(F.lit(role).alias("role"), "x", F.lit("").alias("y"))
    return named("given", given).unionByName(named("family", family)).unionByName(named("word", words))


def _facts(seen: Counter, tokens: Counter) -> pa.RecordBatch:
    for w, n in tokens.items():
        seen["lower" if w.islower() else "upper", w.lower(), ""] += n
    cols = list(zip(*seen)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(seen.values()), pa.int64())], names=["role", "x", "y", "n"])


_TOKEN = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"(?<![\w.])[A-Z]\.\s{1,2}[A-Z][a-z]")


def find(text: str, known: Knowledge) -> list[tuple[int, int, str]]:
    """Sorted spans (start, end, kind) of all personal information in a text."""
    spans = []
    for a, b, kind, form in _spans(text, known.streets):
        if (kind, form) in SEEDS or (kind, form) in known.forms or kind in (known.patterns.get(_before(text, a)), known.instances.get(_key(text[a:b]))):
            spans.append((a, b, kind))
    for m in list(_loose(text, spans)):
        before = _before(text, m.start())
        kind = known.patterns.get(before)
        if kind not in ("phone", "id_number"):
            # a shape that mostly announces one kind, unless its pattern announces something else
            shape, last = _shape(m[0]), before.rsplit(" ", 1)[-1]
            kind = known.instances.get(_key(m[0])) or known.shapes.get(shape)
            if kind and (known.last_words.get(last, kind) != kind or (before, shape) in known.against or (last, shape) in known.against):
                kind = None
        if kind and all(m.end() <= s or e <= m.start() for s, e, _ in spans):
            spans.append((m.start(), m.end(), kind))
    words = _TOKEN.findall(text.lower())
    if not (known.given.isdisjoint(words) and known.family.isdisjoint(words)) or _INITIAL.search(text):
        for a, b in _names(text, known):
            if all(b <= s or e <= a for s, e, _ in spans):
                spans.append((a, b, "person_name"))
    return sorted(spans)


def _names(text: str, known: Knowledge):
    """Spans of names: given name, or an initial with a dot, and family name (double ones too), in either order, in any case."""
    tokens = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text)]
    n = len(tokens)
    blank = lambda g: g == " "
    capital = lambda k: text[tokens[k][0]].isupper()

    def gap(p, q):
        """What lies between two tokens, any short white space as one blank."""
        g = text[tokens[p][1] : tokens[q][0]]
        return re.sub(r"\s+", " ", g) if len(g) < 6 and g.count("\n") < 2 else g

    def unknown(k):
        """A word that the corpus hardly has, as unmet family names are."""
        w = tokens[k][2]
        return len(w) > 3 and w not in known.words and w not in known.given

    def family_at(k, guess=False):
        if k >= n or not (tokens[k][2] in known.family or (guess and unknown(k))):
            return None
        while k + 1 < n and gap(k, k + 1) == "-" and capital(k + 1) == capital(k):
            k += 1
        return k

    def end_of(i):
        w = tokens[i][2]
        if i + 1 < n and w in known.given:
            g = gap(i, i + 1)
            if blank(g) or g == ", ":
                k = family_at(i + 1, guess=blank(g))
                if k is not None:
                    return k
            if blank(g) and i + 2 < n and len(tokens[i + 1][2]) == 1 and gap(i + 1, i + 2) in (". ", " "):
                return family_at(i + 2, guess=True)
            return None
        if len(w) == 1:
            return family_at(i + 1, guess=capital(i) and capital(i + 1) and not text[tokens[i + 1][0] :][:2].isupper()) if i + 1 < n and gap(i, i + 1) in (". ", ".") else None
        k = family_at(i, guess=capital(i))
        if k is not None and k + 1 < n and (gap(k, k + 1) in (", ", ",", " ")):
            nxt, comma = tokens[k + 1][2], "," in gap(k, k + 1)
            sure = w in known.family or comma
            dotted = comma and text[tokens[k + 1][1] : tokens[k + 1][1] + 1] == "."
            if sure and (nxt in known.given or (w in known.family and len(nxt) == 1 and dotted)):
                return k + 1
        return None

    i = 0
    while i < n:
        w = tokens[i][2]
        if w in known.given or w in known.family or len(w) == 1 or (i + 1 < n and tokens[i + 1][2] in known.given):
            j = end_of(i)
            if j is not None and not _attached(text, tokens[i][0], tokens[j][1]):
                yield tokens[i][0], tokens[j][1]
                i = j
        i += 1


def _attached(text: str, a: int, b: int) -> bool:
    """Part of a handle, a path or a longer token."""
    return (a > 0 and (text[a - 1] in "@/_+" or text[a - 1].isdigit())) or (b < len(text) and (text[b] in "@_+" or text[b].isdigit()))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by ``[KIND]``; all else is kept."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def masked_texts(texts: DataFrame, known: Knowledge) -> DataFrame:
    """(id, field, kinds, masked) of rows (id, field, text): the kinds held, sorted, and the text with typed placeholders.

    A null text stays null and an empty one empty, with no kinds.
    """
    schema = "id string, field string, kinds array<string>, masked string"

    def answer(ids, fields, texts: list, known: Knowledge) -> dict:
        kinds, out = [], []
        for t in texts:
            spans = find(t, known) if t else []
            kinds.append(sorted({k for _, _, k in spans}))
            out.append(masked(t, spans) if t else t)
        return {"id": ids, "field": fields, "kinds": pa.array(kinds, pa.list_(pa.string())), "masked": pa.array(out, pa.string())}

    if known.table is not None:
        blocks = max(1, -(-texts.count() // BLOCK))
        placed = texts.select("id", "field", "text", F.pmod(F.xxhash64("id", "field"), F.lit(blocks)).alias("block"))

        def ask(batches):
            for batch in batches:
                asked = {(b, x) for t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in _asked(t)}
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in asked], pa.int64()), pa.array([x for _, x in asked], pa.string())], names=["block", "x"])

        asked = placed.select("text", "block").mapInArrow(ask, "block long, x string").distinct()
        told = asked.join(known.table, "x").select("block", "role", "x", "y")

        def block(rows: pa.Table, facts: pa.Table) -> pa.Table:
            mine = _told(zip(*(facts.column(c).to_pylist() for c in ("role", "x", "y"))))
            return pa.table(answer(rows.column("id"), rows.column("field"), rows.column("text").to_pylist(), mine))

        return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block, schema)

    shared = texts.sparkSession.sparkContext.broadcast(known)

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(answer(batch.column(0), batch.column(1), batch.column(2).to_pylist(), shared.value))

    return texts.select("id", "field", "text").mapInArrow(apply, schema)
