"""Line-first quality rules: clean line by line, then reject documents that lose too much text.

Per line: punctuation (the last line of a paragraph ends a sentence; lines that prose is wrapped into need not), navigation
(separators, links, menu words, runs of very short lines, in any language) and boilerplate (notices of sites). Failing lines
are removed; a document is kept if the base rules hold and the removed words are at most `max_lost` of it. All is done on
whole texts in one pass over each, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ASCII_SPACE, by_rows, slices

# Signs counted as symbols, sentence ends, menu words and notices of web pages.
SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", "…", "。", "！", "？", ":", ";", "”", "\"", "»", ")")
NAVIGATION = (
    "home", "menu", "next", "previous", "login", "log in", "sign in", "sign up", "sitemap", "contact us", "about us", "search", "startseite", "anmelden", "suche", "impressum",
    "inicio", "siguiente", "anterior", "buscar", "accueil", "suivant", "précédent", "rechercher", "главная", "поиск", "войти", "首页", "登录", "搜索",
)
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "javascript is disabled", "click here", "read more", "subscribe to our newsletter", "share on facebook", "share on twitter", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "todos los derechos reservados", "política de privacidad", "tous droits réservés", "politique de confidentialité", "все права защищены", "политика конфиденциальности", "版权所有", "隐私政策",
)
SEPARATORS = frozenset(("|", "·", "•", "»", "›", ">", "/", "::"))

MIN_WORDS, MAX_REPEATED_PERCENT, MAX_LOST, MENU_LINES = 50, 50, 0.5, 4
#: Unicode white space that str.split cuts at and the word class does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
_SHOUTS = re.compile(r"[!?]{2,}|[*#$%&]{2,}")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, where, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[where] > 1)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum())


def line_verdict(line: str, words: list[str], last: bool = True, listed: bool = False) -> str | None:
    """The rule that a line with words fails, or None. `last`: it ends its paragraph; `listed`: it is one of MENU_LINES or more very short lines in a row."""
    lower, n = line.lower(), len(words)
    if listed or line.count("|") >= 3 or sum(lower.count(x) for x in (" > ", " » ", " · ")) >= 3 or n <= 3 and lower.strip(ASCII_SPACE + ".") in NAVIGATION:
        return "navigation"
    if (marks := sum(w in SEPARATORS for w in words)) >= 2 and marks >= 0.25 * n or (links := sum(w.startswith(("http://", "https://", "www.")) for w in words)) >= 2 and links >= 0.5 * n:
        return "navigation"
    if n <= 40 and _BOILER.search(lower):
        return "boilerplate"
    if n >= 5 and len(_SHOUTS.findall(line)) > 0.3 * n:
        return "punctuation"
    if last and n >= 12 and not line.rstrip().endswith(ENDS) and not any(f"{end} " in line for end in ".!?"):
        return "punctuation"
    return None


def in_menus(lines: list[str], words: list[list[str]]) -> list[bool]:
    """Whether each line is one of MENU_LINES or more in a row of at most three words that end no sentence."""
    short = [0 < len(w) <= 3 and not line.rstrip().endswith(ENDS) for line, w in zip(lines, words)]
    out, start = [False] * len(lines), 0
    for k in range(len(lines) + 1):
        if k == len(lines) or not short[k]:
            if k - start >= MENU_LINES:
                out[start:k] = [True] * (k - start)
            start = k + 1
    return out


def clean(text: str, max_lost: float = MAX_LOST) -> dict:
    """Counts, verdicts and the cleaned text of one document."""
    words = words_of(text)
    duplicate, seen, kept, lost = 0, set(), [], 0
    lines = text.split("\n")
    split = [words_of(line) for line in lines]
    menus = in_menus(lines, split)
    for k, (line, own) in enumerate(zip(lines, split)):
        if not own:
            continue
        repeated = line in seen
        seen.add(line)
        duplicate += repeated
        if repeated or line_verdict(line, own, k + 1 == len(lines) or not split[k + 1], menus[k]):
            lost += len(own)
        else:
            kept.append(line)
    covered = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * covered > MAX_REPEATED_PERCENT * len(words)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": duplicate,
        "n_repeat_words": covered, "base_failed": failed, "kept": not failed and lost <= max_lost * len(words), "lost_words": lost, "cleaned": "\n".join(kept),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", max_lost: float = MAX_LOST, cleaned: bool = False) -> DataFrame:
    """Counts and verdict of every row: doc_id, the counts, base_failed, kept, lost_words and, with `cleaned`, the cleaned text.

    A null or empty text has no words, counts 0 and fails. Repeated rows and null keys are judged like any other; an empty table gives
    no rows; other columns, whatever their names, are not looked at.
    """
    names = ("doc_id", *COUNTS, "base_failed", "kept", "lost_words", *(["cleaned"] if cleaned else []))
    kinds = dict.fromkeys(("doc_id", *COUNTS, "lost_words"), "long") | {"base_failed": "boolean", "kept": "boolean", "cleaned": "string"}

    def run(columns: list[list]) -> list[list]:
        rows = [clean(t or "", max_lost) for t in columns[1]]
        return [columns[0], *([r[n] for r in rows] for n in names[1:])]

    return by_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, ", ".join(f"{n} {kinds[n]}" for n in names))


def keep_good(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, cleaned: bool = False) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged: one pass, no join. With `cleaned` their text is the cleaned one, and n_chars, if there is one, its length.

    Null and empty texts fail; repeated rows are judged alike; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, place):
                found = [clean(t or "", max_lost) for t in part.column(place).to_pylist()]
                if cleaned:
                    new = {text: [r["cleaned"] for r in found], "n_chars": [len(r["cleaned"]) for r in found]}
                    columns = [pa.array(new[f.name], type=f.type) if f.name in new else c for f, c in zip(part.schema, part.columns)]
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part.filter(pa.array([r["kept"] for r in found], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
