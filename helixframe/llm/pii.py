"""Surrogates for personal data and secrets, with DataFrame functions alone.

Entities are found by one pattern of alternatives in the texts that can hold any. Each different entity of the corpus gets a
surrogate that follows from a key and the entity, of the same type, format and, for names, gender and script. A surrogate is
taken only if no other entity has it and the corpus holds no such entity itself; else the next attempt's is tried. So the
same entity is replaced by the same surrogate everywhere (coreference), and different ones stay different. Names are replaced
word by word, whatever the title before them, and are found again in the rest of their document without one.

The pattern runs over each text that can hold an entity, and all rows are stored with what it found; texts with entities are
searched again with the names of their own, and cut by what is found. A name that its document also uses in lower case is an
ordinary word there when it stands alone. Only entities are shuffled for the surrogates, and the pieces between them once, by row, to be put together again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, stored

# Titles by gender, in Latin and Cyrillic script, and honorifics in Han script.
MALE, FEMALE, NEUTRAL = ("Mr", "Herr", "Señor", "Sr", "господин", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа"), ("Dr", "Prof")
HAN_MALE, HAN_FEMALE = ("先生",), ("女士", "小姐")
# Syllables of surrogate names and their endings by gender.
SYLLABLES = {
    "latin": ("ba", "be", "co", "da", "el", "fi", "ga", "jo", "ka", "li", "mo", "na", "pe", "ro", "sa", "ti"),
    "cyrillic": ("ба", "ве", "го", "да", "жи", "за", "ка", "ли", "мо", "на", "по", "ра", "се", "ти", "фе", "ло"),
    "han": ("安", "博", "成", "德", "恩", "方", "高", "和", "嘉", "康", "林", "明", "宁", "平", "瑞", "文"),
}
ENDINGS = {
    ("latin", "m"): ("n", "s", "rd", "k"), ("latin", "f"): ("a", "ia", "lle", "ne"), ("latin", "n"): ("r", "x", "y", "t"),
    ("cyrillic", "m"): ("н", "й", "р", "в"), ("cyrillic", "f"): ("я", "ва", "на", "ра"), ("cyrillic", "n"): ("к", "ль", "т", "м"),
    ("han", "m"): ("伟", "强", "军", "刚"), ("han", "f"): ("芳", "娜", "丽", "静"), ("han", "n"): ("一", "东", "南", "西"),
}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_HONORIFICS = "|".join((*HAN_MALE, *HAN_FEMALE))
# What stands before names and national telephone numbers, without a title or country code.
INTRODUCED, LABELLED = ("My name is ", "my name is ", "Ich heiße ", "Me llamo ", "Меня зовут "), ("Contact: ", "Name: ", "Author: ", "Attn: ", "Kontakt: ", "Contacto: ", "Контакт: ")
#: Repetitions are bounded by the format, or of one class and possessive, and start at borders, so long texts take linear time. In the order in which they are tried at a place. The kinds' names are those of the result.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,2}[=:]\s{0,2})(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|[^\s\"']{5,}[^\s\"'.,;:!?)])",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}+\b|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "key_block": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[-.]\d{4}(?!\d)|(?<![\w.-])\d{3}([-.])\d{3}\1\d{4}(?![\d-])|(?<![\w.,/-])0\d{2,4} \d{3,4} \d{3,4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}(?:([ -]?)\d{4}\2\d{4}\2\d{4}|[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "person": rf"\b(?:{_TITLES})\b\.? {_NAME}(?: {_NAME}){{0,2}}|(?<=\b(?:{'|'.join(INTRODUCED)})){_NAME}(?: {_NAME}){{0,2}}|(?<=\b(?:{'|'.join(LABELLED)})){_NAME}(?: {_NAME}){{1,2}}",
    "person_han": rf"[\u4e00-\u9fff]{{1,3}}(?:{_HONORIFICS})",
}
ENTITY = "|".join(PATTERNS.values())
#: What each pattern cannot match without; a text that holds none of it is not searched.
NEEDED = {
    "email": "@", "secret": "[=:]", "key": "AKIA|ASIA|gh[pousr]_|sk-|eyJ", "key_block": "-----BEGIN ", "iban": "[0-9]", "ip": "[0-9]", "phone": "[0-9]", "ssn": "[0-9]", "card": "[0-9]",
    "person": rf"\b(?:{_TITLES})\b|{'|'.join(x.strip() for x in INTRODUCED + LABELLED)}", "person_han": _HONORIFICS,
}
MAYBE = "|".join(dict.fromkeys(NEEDED[kind] for kind in PATTERNS))
ATTEMPTS, KEY = 24, "helixframe"


def _byte(i) -> F.Column:
    """The i-th byte (from 0, modulo 64) of the keyed hash in `h`."""
    return F.conv(F.substring(F.col("h"), i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: str, b) -> F.Column:
    return F.substring(F.lit(values), b % len(values) + 1, F.lit(1))


def _same_format(value) -> F.Column:
    """Each digit and ASCII letter becomes another of its class (hexadecimal strings stay so); all else stays."""
    hexadecimal = value.rlike("^[0-9a-f]+[\"']?$")

    def made(small: str) -> F.Column:
        def one(c, i):
            b = _byte(i + 1) + F.lit(0)
            return F.when(c.between("0", "9"), _pick("0123456789", b)).when(c.between("a", "z"), _pick(small, b)).when(c.between("A", "Z"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return F.when(F.length(value) > 0, F.when(hexadecimal, made("abcdef")).otherwise(made("abcdefghijklmnopqrstuvwxyz"))).otherwise(F.lit(""))


def _luhn(digits) -> F.Column:
    """Sum of the Luhn check over a string of digits."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _mod97(compact) -> F.Column:
    """Remainder by 97 of a string of digits and capitals, which count 10 to 35 (the check of account numbers)."""

    def add(rest, c):
        digit = c.between("0", "9")
        return ((rest * F.when(digit, 10).otherwise(100) + F.when(digit, c.cast("int")).otherwise(F.ascii(c) - 55)) % 97).cast("int")

    return F.aggregate(F.filter(F.split(compact, ""), lambda c: c != ""), F.lit(0), add)


def _name(attempt: int) -> F.Column:
    """A name of syllables in the kind's script with the ending of its gender; every attempt has a syllable more."""
    branches = None
    for (script, gender), ends in ENDINGS.items():
        syllables = SYLLABLES[script]
        count = (1 if script == "han" else 2) + attempt
        parts = [F.element_at(F.array(*map(F.lit, syllables)), _byte(F.lit(k)) % len(syllables) + 1) for k in range(count)]
        name = F.concat(*parts, F.element_at(F.array(*map(F.lit, ends)), _byte(F.lit(60)) % len(ends) + 1))
        kind = (F.col("kind") == f"name_{script}") & (F.col("gender") == gender)
        branches = (branches.when if branches is not None else F.when)(kind, F.initcap(name))
    return branches


def _kept(pattern: str) -> F.Column:
    return F.regexp_extract("value", pattern, 1)


def _surrogate(attempt: int) -> F.Column:
    """Of (kind, value) with hash h."""
    value = F.col("value")

    def behind(pattern: str):
        head = _kept(pattern)
        return F.concat(head, _same_format(value.substr(F.length(head) + 1, F.length(value))))

    octets = F.concat_ws(".", (240 + _byte(F.lit(0)) % 15).cast("string"), *((1 + _byte(F.lit(k)) % 254).cast("string") for k in range(1, 4)))
    # of an address; every attempt is a letter longer, so short ones do not run out
    local = F.concat(_same_format(F.regexp_extract("value", "^([^@]*)@", 1)), *(_pick(LOWER, _byte(F.lit(40 + k))) for k in range(attempt)))
    made = F.concat(F.substring("value", 1, 1), _same_format(value.substr(F.lit(2), F.length(value))))
    front = made.substr(F.lit(1), F.length(made) - 1)
    check = ((10 - _luhn(F.concat(F.regexp_replace(front, "[^0-9]", ""), F.lit("0"))) % 10) % 10).cast("string")
    valid = _luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0
    account, country = _same_format(value.substr(F.lit(5), F.length(value))), F.substring("value", 1, 2)
    compact, body = F.replace(value, F.lit(" "), F.lit("")), F.replace(account, F.lit(" "), F.lit(""))
    sound = _mod97(F.concat(compact.substr(F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1
    digits = F.when(sound, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(_same_format(F.substring("value", 3, 2)))
    found = (
        F.when(F.col("kind") == "local", local)
        .when(F.col("kind") == "domain", F.concat(F.lit("host-"), F.substring("h", 100, 6 + attempt), F.lit(".example.org")))
        .when(F.col("kind") == "secret", behind(r"^([A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?)"))
        .when(F.col("kind") == "key", behind(r"^(AKIA|ASIA|gh[pousr]_|sk-|eyJ)"))
        .when(F.col("kind") == "key_block", F.concat(_kept(r"^(-----[A-Z ]+-----)"), _same_format(_kept(r"^-----[A-Z ]+-----([^-]*)")), _kept(r"(-----END [A-Z ]+-----)$")))
        .when(F.col("kind") == "iban", F.concat(country, digits, account))
        .when(F.col("kind") == "phone", behind(r"^(\+\d{1,3}|0|)"))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", F.when(valid, F.concat(front, check)).otherwise(made))
        .when(F.col("kind").startswith("name_"), _name(attempt))
        .otherwise(_same_format(value))
    )
    return found if attempt < ATTEMPTS else F.concat(found, F.lit("-"), F.substring("h", 1, 24))


def surrogates(values: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) for different (kind, value, gender): one to one within a kind, and never an entity of the corpus.

    A later attempt is made only for what is still open; names, local parts and domains grow with it. Where a format has hardly
    more members than the corpus has entities, the last attempt adds a tail: distinct, though of another format.
    """
    values = stored(values, "entities")
    open_, taken = values, None
    for attempt in range(ATTEMPTS + 1):
        cand = open_.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), "kind", "value"), 512)).withColumn("surrogate", _surrogate(attempt)).drop("h")
        # an address is held against local parts: its own domain may be one that stays
        real = values.select("kind", F.when(F.col("kind") == "local", F.regexp_extract("value", "^([^@]*)@", 1)).otherwise(F.col("value")).alias("surrogate")).distinct()
        free = cand.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "surrogates")
        taken = won if taken is None else taken.unionAll(won)
        open_ = stored(open_.join(won, ["kind", "value"], "left_anti"), "open")
        if not open_.limit(1).count():
            break
    return taken


def _kind(entity) -> F.Column:
    """The first pattern that matches as a whole; names found by what stands before them, or again without a title, match none."""
    whole = reduce(lambda found, item: found.when(entity.rlike(f"^(?:{item[1].replace(chr(92) + '2', chr(92) + '1') if item[0] == 'card' else item[1]})$"), F.lit(item[0])), PATTERNS.items(), F)
    return whole.when(entity.rlike(r"^[\u4e00-\u9fff]+$"), F.lit("person_han")).otherwise(F.lit("person"))


def _untitled(entity) -> F.Column:
    return F.regexp_replace(entity, rf"^(?:{_TITLES})\b\.? ", "")


def _names(entities) -> F.Column:
    """The words of the names among the entities: each stands for its person in the rest of the text. Of Han names those of two signs or more."""
    titled = rf"^(?:{_TITLES})\b\.? {_NAME}|^{_NAME}(?: {_NAME}){{0,2}}$"

    def words(e):
        han = F.regexp_extract(e, rf"^([\u4e00-\u9fff]{{2,3}})(?:{_HONORIFICS})$", 1)
        return F.when(han != "", F.array(han)).when(e.rlike(titled) & ~e.rlike("[0-9@=:]"), F.split(_untitled(e), " ")).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(entities, words))))


def _no_words(names, text) -> F.Column:
    """The names that the text does not also use as ordinary words, in lower case."""
    used = F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit(r"(?<!\p{L})(?:"), F.lower(F.array_join(names, "|")), F.lit(r")(?!\p{L})")), F.lit(0)))
    return F.when(F.size(names) > 0, F.array_except(names, F.filter(names, lambda n: F.array_contains(used, F.lower(n)) & (F.lower(n) != n)))).otherwise(names)


def _pattern(names) -> F.Column:
    """ENTITY, and the document's names where they stand alone. They hold letters, hyphens and apostrophes only."""
    han, other = (F.array_join(F.filter(names, lambda n: n.rlike(r"^[\u4e00-\u9fff]") == is_han), "|") for is_han in (True, False))
    alone = F.when(other != "", F.concat(F.lit(r"|(?<![\p{L}\p{Nd}])(?=\p{Lu})(?:"), other, F.lit(r")(?!\p{L})"))).otherwise("")
    return F.concat(F.lit(ENTITY), alone, F.when(han != "", F.concat(F.lit("|(?:"), han, F.lit(")"))).otherwise(""))


def _parts() -> F.Column:
    """Array of (kind, value, gender, replaced) that joined make the entity: names and addresses are split, titles, blanks and honorifics stay."""
    entity = F.col("entity")
    title = F.regexp_extract(entity, rf"^((?:{_TITLES})\b\.? )", 1)
    bare = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")

    def piece(kind, value, replaced, gender="n"):
        kind, gender = (F.lit(x) if isinstance(x, str) else x for x in (kind, gender))
        return F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"), F.lit(replaced).alias("replaced"))

    named = F.transform(F.split(_untitled(entity), " "), lambda w: piece(F.when(w.rlike(r"^\p{IsCyrillic}"), "name_cyrillic").otherwise("name_latin"), w, True, gender))
    spaced = F.flatten(F.transform(named, lambda x, i: F.when(i == 0, F.array(piece("as_is", title, False), x)).otherwise(F.array(piece("as_is", F.lit(" "), False), x))))
    honorific = F.regexp_extract(entity, f"({_HONORIFICS})$", 1)
    han_gender = F.when(honorific.isin(*HAN_MALE), "m").when(honorific.isin(*HAN_FEMALE), "f").otherwise("n")
    han = F.array(piece("name_han", entity.substr(F.lit(1), F.length(entity) - F.length(honorific)), True, han_gender), piece("as_is", honorific, False))
    # an address is one whatever its case; addresses of a domain keep a domain together
    address, domain = F.lower(entity), F.regexp_extract(F.lower(entity), "@(.*)$", 1)
    home = F.when(domain.rlike(r"(^|\.)example\.(com|net|org)$"), piece("as_is", domain, False)).otherwise(piece("domain", domain, True))
    mail = F.array(piece("local", address, True), piece("as_is", F.lit("@"), False), home)
    return F.when(F.col("kind") == "person", spaced).when(F.col("kind") == "person_han", han).when(F.col("kind") == "email", mail).otherwise(F.array(piece(F.col("kind"), entity, True)))


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY, counts: bool = False, lengths: str | None = None) -> DataFrame:
    """`docs` with surrogates in `text`; with `counts` also n_entities and entity_kinds (array of kinds in order); the column `lengths` gets the length of texts that change.

    All other columns and rows stay, repeated ones too (they get the same surrogates); null and empty texts stay as they are, an
    empty table stays empty. With `counts`, columns of `docs` named n_entities or entity_kinds give way to the new ones.
    """
    names = [c for c in docs.columns if not (counts and c in ("n_entities", "entity_kinds"))]
    others = [F.col(f"`{c}`") for c in names if c != text]
    source = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("others"), F.col(f"`{text}`").alias("text"))
    # the pattern runs once over a text; all rows are stored with what it found
    none = F.array().cast("array<string>")
    found = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(none)
    first = stored(source.withColumn("entities", F.coalesce(found, none)), "found")
    same = first.where(F.size("entities") == 0).select("others", "text", F.lit(0).cast("long").alias("n_entities"), F.col("entities").alias("entity_kinds"))
    # texts with names are searched again for these
    again = first.where(F.size("entities") > 0).withColumn("pattern", _pattern(_no_words(_names(F.col("entities")), F.col("text")))).withColumn("entities", F.when(F.col("pattern") == ENTITY, F.col("entities")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    hits = stored(again.select(F.monotonically_increasing_id().alias("uid"), "others", "entities", F.split("text", F.col("pattern"), -1).alias("between")), "hits")
    parts = hits.select("uid", F.posexplode("entities").alias("at", "entity")).withColumn("kind", _kind(F.col("entity"))).select("uid", "at", F.col("kind").alias("whole"), F.posexplode(_parts()).alias("part", "p")).select("uid", "at", "whole", "part", "p.*")
    parts = stored(parts, "parts")
    # a name's gender is that of its titles in the corpus, if they agree
    male, female = (F.max((F.col("gender") == g).cast("int")) for g in "mf")
    gender = F.when(male > female, "m").when(female > male, "f").otherwise("n").alias("gender")
    known = surrogates(parts.where("replaced").groupBy("kind", "value").agg(gender), key)
    missing = F.raise_error(F.concat(F.lit("no surrogate for an entity of kind "), F.col("kind"))).cast("string")
    replaced = parts.where("replaced").join(known, ["kind", "value"], "left").select("uid", "at", "whole", "part", F.coalesce("surrogate", missing).alias("new"))
    filled = replaced.unionAll(parts.where("NOT replaced").select("uid", "at", "whole", "part", F.col("value").alias("new")))
    # first the parts of each entity, then the entities of each text: entity k is element k
    entities = filled.groupBy("uid", "at").agg(F.array_sort(F.collect_list(F.struct("part", "new"))).alias("x"), F.first("whole").alias("whole")).select("uid", F.struct("at", F.array_join(F.transform("x", lambda y: y["new"]), "").alias("new"), "whole").alias("e"))
    put = hits.join(entities.groupBy("uid").agg(F.array_sort(F.collect_list("e")).alias("x")), "uid")
    middle = F.zip_with("between", "x", lambda s, e: F.concat(s, F.coalesce(e["new"], F.lit(""))))
    done = put.select("others", F.array_join(middle, "").alias("text"), F.size("entities").cast("long").alias("n_entities"), F.transform("x", lambda e: e["whole"]).alias("entity_kinds"))
    both = same.unionAll(done)
    put_in = lambda c: F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"others.`{c}`")) if c == lengths else F.col(f"others.`{c}`")
    out = [F.col("text").alias(text) if c == text else put_in(c).alias(c) for c in names]
    return both.select(*out, *(["n_entities", "entity_kinds"] if counts else []))
