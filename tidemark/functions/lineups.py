"""Line-ups of shows: performers, headliner first, from one title. A title is scanned once, character by character for what
is set apart in quotes or brackets, then word by word; every word either opens the next act, ends the part it is in, or belongs
to the act being read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

# Characters that quote, words that part acts, that bring in support, that follow a host's name, and what is said
# of evenings that have no artist of their own.
QUOTES = "\"“”„‟"
PARTS = ("/", "+")
SUPPORT = ("w/", "with")
HOSTS = ("presents", "presents:")
NO_ARTIST_WORDS = ("tribute", "screening")
NO_ARTIST_STEMS = ("celebrat",)
NO_ARTIST_PHRASES = ("in concert", "music of", "years of", "salute to", "the making of", "live to film", "film with live")


def set_apart(title: str) -> tuple[str, list[str], list[str]]:
    """A title without what stands in quotes or brackets; the quotes; the brackets. Unclosed ones are plain text."""
    plain, quoted, bracketed, at = [], [], [], 0
    while at < len(title):
        sign = title[at]
        ends = [i for i, c in enumerate(title[at + 1 :], at + 1) if c in QUOTES][:1] if sign in QUOTES else [title.find(")", at)] if sign == "(" else [-1]
        end = ends[0] if ends else -1
        if end < 0:
            plain.append(sign)
            at += 1
            continue
        (bracketed if sign == "(" else quoted).append(title[at + 1 : end])
        plain.append(" ")
        at = end + 1
    return "".join(plain), quoted, bracketed


class _Scan:
    """Acts found so far, and the one being read."""

    def __init__(self):
        self.acts: list[list[str]] = [[]]
        self.support = self.muted = False

    def read(self, word: str) -> None:
        low = word.casefold()
        if low in SUPPORT and not self.support:
            self.support, self.muted = True, False
            self.acts.append([])
        elif self.muted:
            return
        elif low in PARTS:
            self.acts.append([])
        elif low in HOSTS and self.acts[-1]:
            self.acts[-1] = []  # a host, not an act
        elif low == "-" and not self.support:
            self.muted = True  # what the evening is called
        elif word.endswith(":") and not self.support:
            self._colon(word[:-1])
        elif word.endswith(","):
            self.acts[-1].append(word[:-1])
            self.acts.append([])
        else:
            self.acts[-1].append(word)

    def _colon(self, word: str) -> None:
        """Behind the name of a tour comes who is on it; behind anything else, what it is about."""
        self.acts[-1].append(word)
        if any(_is_tour(act) for act in self.acts):
            self.acts = [[]]
        else:
            self.muted = True


def _is_tour(act: list[str]) -> bool:
    return any(word.strip(",.:;!?").casefold() == "tour" for word in act)


def split_lineup(title: str) -> list[str]:
    """Performers of a title, each once; tours are no performers, and "&" and "and" never part names."""
    for text in (set_apart(title)[0], title):  # a name that is all quoted counts as it is
        if text.strip():
            break
    scan = _Scan()
    for word in text.replace(" ,", ",").split():
        scan.read(word)
    names = (" ".join(act).strip(" -:,") for act in scan.acts if not _is_tour(act))
    return list(dict.fromkeys(name for name in names if name))


def clean_performer(name: str) -> tuple[str, str | None]:
    """A performer without a host before it, and the note in brackets behind it."""
    words = name.split()
    hosts = [i for i, word in enumerate(words[:-1]) if i and word.casefold() in HOSTS]
    text = " ".join(words[hosts[0] + 1 :] if hosts else words)
    head, bracket, note = text.rpartition("(")
    if bracket and head.strip() and note.endswith(")") and note.count(")") == 1:
        return head.strip(), note[:-1].strip() or None
    return text, None


def _is_show(words: list[str]) -> bool:
    """"The ... Show", in one clause, with up to forty letters between."""
    for i, word in enumerate(words):
        if word in ("a", "the"):
            for j in range(i + 2, len(words)):
                if words[j] == "show" and 2 <= len(" ".join(words[i + 1 : j])) <= 40:
                    return True
    return False


def non_artist_event(title: str) -> bool:
    """Tributes, screenings, contests of records and the like: evenings of music by others."""
    low = title.casefold()
    words = [w for w in "".join(c if c.isalnum() else " " for c in low).split()]
    spaced = f" {' '.join(words)} "
    clauses = "".join("\n" if c in ",/()" else c for c in low).split("\n")
    return (
        not set(NO_ARTIST_WORDS).isdisjoint(words)
        or any(word.startswith(NO_ARTIST_STEMS) for word in words)
        or any(f" {phrase} " in spaced for phrase in NO_ARTIST_PHRASES)
        or "vs" in words[:-1]
        or any(_is_show([w.strip(".:;!?\"'") for w in clause.split()]) for clause in clauses)
        or len(set_apart(title)[1]) > 1
    )


@F.pandas_udf(ArrayType(StringType()))
def split_lineup_udf(titles: pd.Series) -> pd.Series:
    return titles.map(split_lineup, na_action="ignore")


@F.pandas_udf(StructType().add("name", "string").add("note", "string"))
def clean_performer_udf(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if n is None else clean_performer(n) for n in names], columns=["name", "note"])


@F.pandas_udf(BooleanType())
def non_artist_event_udf(titles: pd.Series) -> pd.Series:
    return titles.map(non_artist_event, na_action="ignore")
