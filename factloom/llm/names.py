"""Reading freely typed names with a vocabulary learned from the names themselves.

``learn_vocabularies`` finds, per label, the words that many names share although their other
words differ: a word is generic if most names that hold it also hold a rarer word. No list
of lines of business, editions, company words or given names is built in. What such a word
does follows from where it stands: generic words that mostly close a name are its legal form
(organisations), the others tell entities apart (lines, editions); generic words of persons
are given names. Words that mostly stand in brackets are additions. Two generic words that
never come without each other are one ('x & y').

``read_name`` folds a name (accents, case, punctuation, brackets, glued words), resolves its
words to the vocabulary also when misspelt or shortened, and calls what is left the stem.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import cut

# General English and registry vocabulary that carries nothing in a name.
STOP = set("a an and new of our the".split())
TITLES = set("dame dr lady lord miss mr mrs ms mx prof professor rev sir".split())
NUMBER_MARKS = set("gen generation issue mark mk model no nr num number series type ver version".split())
#: Abbreviations of legal forms in company registers.
LEGAL_FORMS = set("ab ag as asa bhd bv co corp gmbh inc kg kk lp llc llp ltd nv oy oyj plc pte pty sa sarl sas se spa srl".split())
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: English short forms that do not follow from the letters of the given name.
SHORT_FORMS = {
    "al": "albert alfred alvin", "barney": "bernard", "bess": "elizabeth", "bessie": "elizabeth", "bill": "william", "billy": "william",
    "bob": "robert", "bobby": "robert", "buck": "charles", "chuck": "charles", "dick": "richard", "dolly": "dorothy", "fritz": "frederick",
    "gerry": "gerald gerard", "gus": "augustus gustav", "hal": "harold henry", "hank": "henry", "harry": "harold henry", "izzy": "isabella isidore isaac",
    "jack": "john jackson", "jim": "james", "jimmy": "james", "kit": "christopher katherine", "kitty": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
    "libby": "elizabeth", "liza": "elizabeth", "madge": "margaret", "maggie": "margaret", "mamie": "mary", "meg": "margaret", "mick": "michael",
    "mike": "michael", "mitch": "mitchell", "molly": "mary", "nan": "anna nancy", "ned": "edward edmund", "nell": "eleanor helen",
    "nellie": "eleanor helen", "peg": "margaret", "peggy": "margaret", "polly": "mary pauline", "rick": "richard frederick", "sally": "sarah",
    "sadie": "sarah", "sandy": "alexander alexandra sandra", "sasha": "alexander alexandra", "shelly": "michelle", "stella": "estelle",
    "ted": "edward theodore edmund", "teddy": "edward theodore", "terry": "terence theresa", "thea": "dorothea theodora", "tom": "thomas",
    "tommy": "thomas", "tony": "anthony", "tricia": "patricia", "trish": "patricia", "trudy": "gertrude", "wendy": "gwendolyn", "winnie": "winifred",
}

KNOWN_GIVEN = {full for names in SHORT_FORMS.values() for full in names.split()}
NOT_LEARNED = STOP | TITLES | NUMBER_MARKS | LEGAL_FORMS | set(ROMAN)

_TOKENS = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_VOWELS = set("aeiou")


@dataclass(frozen=True)
class Name:
    """``stem`` tells the entity among those with the same ``guard``.

    ``extra`` only supports: legal forms, or a person's possible given names. ``words`` are
    the words of the stem one by one.
    """

    stem: str
    guard: str
    extra: str = ""
    words: tuple[str, ...] = ()


def fold(text: str) -> str:
    """Without accents and apostrophes; case kept."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).replace("'", "").replace("’", "")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` when it is over ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def _without_letters(word: str, n: int) -> set[str]:
    out = {word}
    for _ in range(n):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return out


def shortens(token: str, word: str) -> bool:
    """Is ``token`` a shortening of ``word``: its letters in order from the first, maybe with a plural s."""
    for t in (token, token[:-1] if token.endswith("s") else token):
        if not t or t[0] != word[0] or len(t) >= len(word):
            continue
        rest = iter(word)
        if all(c in rest for c in t):
            return True
    return False


def is_short_form(token: str, full: str) -> bool:
    """Is ``token`` an everyday short form of the given name ``full``.

    By its letters: without a closing -ie, -ey, -y, -i or -e and with doubled letters single,
    the beginning of the name (two letters at least), or three letters or more from inside it.
    """
    if full in SHORT_FORMS.get(token, "").split():
        return True
    if not 2 <= len(token) <= 7:
        return False
    single = lambda w: re.sub(r"(.)\1+", r"\1", w.replace("ck", "c"))
    whole = single(full)
    for root in {token, re.sub(r"(ie|ey|y|i|e)$", "", token)}:
        root = single(root)
        if len(root) >= 2 and len(root) <= 0.75 * len(whole) and (whole.startswith(root) or (len(root) >= 3 and root in whole)):
            return True
    return False


@dataclass
class Vocabulary:
    """What was learned for one label: word counts of generic words, and of likely aliases of them."""

    counts: dict[str, int] = field(default_factory=dict)
    closing: set[str] = field(default_factory=set)
    additions: set[str] = field(default_factory=set)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    recurring: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.seen: dict[str, str | None] = {}
        self.given: dict[str, tuple[str, ...]] = {}

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Frequent tokens that shorten, lengthen or misspell a more frequent generic word."""
        out = {w: w for w in self.counts}
        for token, n in sorted(self.recurring.items()):
            near = [w for w, m in self.counts.items() if m > n and w != token and self._stands_for(token, w)]
            if near:
                out[token] = max(near, key=lambda w: (w.startswith(token) or token.startswith(w), self.counts[w], w))
        return {t: out.get(w, w) for t, w in out.items()}

    @staticmethod
    def _stands_for(token: str, word: str) -> bool:
        longer = len(word) >= 3 and len(token) >= len(word) + 3 and token.startswith(word)
        return longer or shortens(token, word) or (len(token) >= 4 and len(word) >= 4 and edits(token, word, 1) <= 1)

    @cached_property
    def words(self) -> list[str]:
        """Generic words that are no alias of another."""
        return sorted({w for w in self.aliases.values()})

    @cached_property
    def _near(self) -> dict[str, list[str]]:
        """Deletion neighbourhoods of the generic words, one letter, two from nine letters on."""
        out: dict[str, list[str]] = {}
        for w in self.words:
            if len(w) >= 4:
                for k in _without_letters(w, 2 if len(w) >= 9 else 1):
                    out.setdefault(k, []).append(w)
        return out

    def exact(self, token: str) -> str | None:
        return self.aliases.get(token)

    def typo(self, token: str, least: int = 4) -> str | None:
        """The generic word that the token misspells: one edit, two from nine letters on."""
        if token in self.seen:
            return self.seen[token]
        found = None
        if least <= len(token) <= 64:
            met = {w for k in _without_letters(token, 2 if len(token) >= 8 else 1) for w in self._near.get(k, ())}
            if len(self.seen) > 200_000:
                self.seen.clear()
            fits = [(d, -self.counts.get(w, 0), w) for w in met if (d := edits(token, w, most := 2 if len(w) >= 9 else 1)) <= most]
            found = min(fits)[2] if fits else None
        self.seen[token] = found
        return found

    def shortened(self, token: str, closing: bool | None) -> str | None:
        """The generic word (closing, not closing, or either) that the token shortens: its beginning, or its consonants."""
        if len(token) > 9:
            return None
        fits = [w for w in self.words if len(w) > 2 and (closing is None or (w in self.closing) == closing) and shortens(token, w)]
        prefix = [w for w in fits if w.startswith(token.rstrip("s"))]
        if closing:  # two words may share their first letters; a legal form is not told apart
            fits = [w for w in fits if (w.startswith(token.rstrip("s")) and len(token) > 2) or not set(token[1:]) & _VOWELS]
            prefix = [w for w in prefix if w in fits]
        best = prefix or (fits if closing or len(fits) == 1 else [])
        if len(token) == 1 and len(best) > 1:
            return None
        return max(best, key=lambda w: (self.counts.get(w, 0), w)) if best else None

    def lengthened(self, token: str) -> str | None:
        """The generic word that the token writes out: it begins with it."""
        fits = [w for w in self.words if len(w) >= 3 and len(token) >= len(w) + 3 and token.startswith(w)]
        return max(fits, key=len) if fits else None

    def pull(self, token: str) -> list[str]:
        """Split generic words off the end of a glued token."""
        out: list[str] = []
        while token not in self.aliases:
            k = next((k for k in range(4, len(token) - 2) if token[-k:] in self.counts), None)
            if k is None:
                break
            token, out = token[:-k], [token[-k:], *out]
        return [token, *out]

    def full_names(self, token: str) -> tuple[str, ...]:
        """The learned given names the token may stand for; none if it is no given name."""
        if token not in self.given:
            self.given[token] = self._full_names(token)
        return self.given[token]

    def _full_names(self, token: str) -> tuple[str, ...]:
        own = self.counts.get(token, 0)
        if fuller := [w for w, n in self.counts.items() if n > own and is_short_form(token, w)]:
            return tuple(sorted(fuller))
        if own or token in KNOWN_GIVEN:
            return (token,)
        if token in SHORT_FORMS:
            return tuple(SHORT_FORMS[token].split())
        return self.full_names(w) if (w := self.typo(token)) else ()


EMPTY = Vocabulary()


def _fields(text: str, label: str | None) -> tuple[list[str], set[str]]:
    """Lower-case words outside and inside brackets."""
    text = fold(text)
    inside = {w for part in _BRACKETS.findall(text) for w in _TOKENS.findall(part.lower())}
    text = _BRACKETS.sub(" ", text)
    if label == "Product":
        return _PARTS.findall(re.sub(r"\+(?=\s|$|-|_)", " plus ", text).lower()), inside
    if label == "Organization" and text != text.upper():
        text = _CAMEL.sub(" ", text)
    return _TOKENS.findall(text.lower()), inside


def read_organization(text: str, v: Vocabulary) -> Name:
    found, _ = _fields(text, "Organization")
    for a, b in v.pairs:  # 'o & g'
        for k in range(len(found) - 1):
            if {found[k], found[k + 1]} == {a[0], b[0]} and found[k : k + 2] != [a, b]:
                found[k : k + 2] = [a, b]
    tokens = [p for t in found if t not in STOP for p in v.pull(t)]
    lines, legal, rest = set(), set(), []
    for t in tokens:
        if w := v.exact(t) or v.typo(t):
            (legal if w in v.closing else lines).add(w)
        elif t in LEGAL_FORMS:
            legal.add(t)
        elif t not in v.additions:
            rest.append(t)
    longest = max(rest, key=len, default="")
    if not lines:  # one of the rest may be a shortened line; the stem is the longest
        for t in [t for t in rest if t is not longest]:
            if w := v.shortened(t, False):
                lines.add(w)
                rest.remove(t)
                break
    for t in [t for t in rest if t is not longest and len(t) > 1]:
        if w := v.shortened(t, True):
            legal.add(w)
            rest.remove(t)
    for a, b in v.pairs:
        if a in lines or b in lines:
            other = b if a in lines else a
            if other not in lines and len(rest) > 1:  # the pair's other word, misspelt
                if typed := next((t for t in rest if t is not longest and edits(t, other, 1) <= 1), None):
                    rest.remove(typed)
            lines |= {a, b}
    return Name("".join(rest), " ".join(sorted(lines)), " ".join(sorted(legal)), tuple(rest))


def read_product(text: str, v: Vocabulary) -> Name:
    tokens = [t for t in _fields(text, "Product")[0] if t not in NUMBER_MARKS and (t not in STOP or t == "a") and (t not in v.additions or t in v.counts)]
    roman = not any(t.isdigit() for t in tokens)  # beside digits a letter is no numeral
    numbers, editions, rest = [], set(), []
    for t in tokens:
        if t.isdigit():
            numbers.append(str(int(t)))
        elif roman and t in ROMAN and len(tokens) > 1:
            numbers.append(str(ROMAN[t]))
        elif (w := v.exact(t) or v.typo(t, 3)) and len(tokens) > 1:
            editions.add(w)
        else:
            rest.append(t)
    if not editions and len(rest) > 1:
        longest = max(rest, key=len)
        for t in [t for t in rest if t is not longest and (len(t) > 1 or t == tokens[-1])]:  # a lone letter only at the end
            if w := v.shortened(t, None):
                editions.add(w)
                rest.remove(t)
                break
        for t in [] if editions else rest[1:]:
            if w := v.lengthened(t):
                editions.add(w)
                rest.remove(t)
                break
    rest = [t for t in rest if t != "a" or len(rest) == 1]
    return Name("".join(rest), " ".join(numbers) + "|" + " ".join(sorted(editions)), "", tuple(rest))


def read_person(text: str, v: Vocabulary) -> Name:
    """The guard holds the possible first letters of the given name, ``extra`` the possible given names."""
    tokens = [t for t in _fields(text, "Person")[0] if t not in TITLES and t not in STOP - {"a"}]
    if "," in text:  # Surname, Given
        head = len([t for t in _TOKENS.findall(_BRACKETS.sub(" ", fold(text)).split(",")[0].lower()) if t not in TITLES])
        tokens = tokens[head:] + tokens[:head]
    known = [k for k, t in enumerate(tokens) if len(t) > 1 and v.full_names(t)]
    known.sort(key=lambda k: (tokens[k] not in v.counts, k))
    if known and len(tokens) > 1:
        names = v.full_names(tokens[known[0]])
        rest = [t for k, t in enumerate(tokens) if k != known[0] and len(t) > 1]
    elif initial := next((t for t in tokens if len(t) == 1 and t.isalpha()), None):
        rest = [t for t in tokens if len(t) > 1]
        return Name("".join(rest), initial, "", tuple(rest))
    elif len(tokens) > 1:
        names, rest = (tokens[0],), tokens[1:]
    else:
        return Name("".join(tokens), "", "", tuple(tokens))
    return Name("".join(rest), "".join(sorted({n[0] for n in names})), " ".join(names), tuple(rest))


READERS = {"Organization": read_organization, "Product": read_product, "Person": read_person}


def read_name(label: str | None, text: str | None, vocabularies: dict[str, Vocabulary]) -> Name:
    """The reading under its label; labels without a reader have all words as the stem."""
    if text is None:
        return Name("", "")
    reader = READERS.get(label or "")
    if reader:
        return reader(text, vocabularies.get(label, EMPTY))
    words = tuple(_TOKENS.findall(fold(text).lower()))
    return Name("".join(words), "", "", words)


def same_given(a: str, b: str) -> bool:
    """Can two readings' given names be one: a name in common, or one misspelt or short for the other; '' is unknown."""
    one, two = a.split(), b.split()
    return not one or not two or any(x == y or is_short_form(x, y) or is_short_form(y, x) for x in one for y in two)


def learn_vocabularies(names: DataFrame, reference: DataFrame | None = None, share: float = 0.004, alias_share: float = 0.0005) -> dict[str, Vocabulary]:
    """label -> Vocabulary from distinct spellings (label, name), and a cleaner ``reference`` of the same columns.

    Counted over all spellings. A word is generic with ``share`` of its label's spellings (of
    the reference's, or of the names'; four at least) if 60 % of them hold a rarer word. What
    is collected is bounded: a label has at most mean words a name / ``alias_share`` words.
    Whether a word closes names is taken from the reference where it is there.
    """
    union = names.select("label", "name", F.lit(False).alias("ref"))
    if reference is not None:
        union = union.unionByName(reference.select("label", "name", F.lit(True).alias("ref")))
    union = union.filter(F.col("label").isin(list(READERS)) & F.col("name").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, name, ref in batch.itertuples(index=False):
                out, inside = _fields(name, label)
                out = [t for t in out if t.isalpha() and len(t) > 1 and t not in NOT_LEARNED]
                key, last = f"{label}\0{name}", out[-1] if out else None
                rows += [(key, label, ref, t, t == last, False) for t in set(out)] + [(key, label, ref, t, False, True) for t in inside if t.isalpha() and t not in STOP]
            yield pd.DataFrame(rows, columns=["key", "label", "ref", "token", "last", "inside"])

    tokens = union.mapInPandas(run, "key string, label string, ref boolean, token string, last boolean, inside boolean")
    tokens = cut(tokens.withColumn("key", F.xxhash64("key", "ref")))
    sizes = {(r["label"], r["ref"]): r["n"] for r in union.groupBy("label", "ref").agg(F.count("*").alias("n")).collect()}
    df = tokens.filter("not inside").groupBy("label", "ref", "token").agg(F.count("*").alias("df"))
    placed = tokens.filter("not inside").join(df, ["label", "ref", "token"])
    held = placed.groupBy("key", "label", "ref").agg(F.collect_list(F.struct("df", "token", "last")).alias("ws"), F.min(F.struct("df", "token")).alias("rarest"))
    each = held.select("label", "ref", "rarest", F.explode("ws").alias("w"))
    rarer = F.col("rarest.df") < F.col("w.df")
    stats = each.groupBy("label", "ref", F.col("w.token").alias("token")).agg(
        F.count("*").alias("n"), F.count_if(rarer).alias("rarer"), F.approx_count_distinct(F.when(rarer, F.col("rarest.token"))).alias("companions"), F.count_if("w.last").alias("last")
    )
    size = names.sparkSession.createDataFrame([(*k, n) for k, n in sizes.items()] or [("", False, 0)], "label string, ref boolean, size long")
    stats = stats.join(F.broadcast(size), ["label", "ref"])
    often = stats.filter((F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("size") * alias_share))) & (F.col("rarer") >= 0.6 * F.col("n")) & (F.col("companions") >= 3))
    often = often.collect()
    brackets = tokens.groupBy("label", "ref", "token").agg(F.count_if("inside").alias("inside"), F.count("*").alias("n")).join(F.broadcast(size), ["label", "ref"])
    brackets = brackets.filter((F.col("inside") >= F.greatest(F.lit(2), F.ceil(F.col("size") * alias_share))) & (2 * F.col("inside") >= F.col("n"))).select("label", "token").distinct().collect()

    out: dict[str, Vocabulary] = {}
    for label in sorted({k[0] for k in sizes}):
        v = out[label] = Vocabulary()
        rows = [r for r in often if r["label"] == label]
        v.additions = {r["token"] for r in brackets if r["label"] == label}
        least = {ref: max(4, share * sizes.get((label, ref), 0)) for ref in (True, False)}
        refs = {r["token"]: r for r in rows if r["ref"] and r["n"] >= least[True]}
        own = {r["token"]: r for r in rows if not r["ref"]}
        generic = {t: r["n"] for t, r in own.items() if r["n"] >= least[False]}
        # a clean reference decides which words are generic; typed names only add spellings of them
        v.counts = {t: r["n"] + generic.get(t, 0) for t, r in refs.items()} if refs else generic
        v.recurring = {t: r["n"] for t, r in own.items() if t not in v.counts}
        place = refs or own
        v.closing = {t for t in v.counts if 2 * place[t]["last"] >= place[t]["n"]}
        if label == "Person":  # a given name seldom closes a name; a frequent surname does
            v.counts = {t: n for t, n in v.counts.items() if t not in v.closing}
    words = [(label, w) for label, v in out.items() for w in v.counts if label == "Organization" and w not in v.closing]
    if words:
        listed = names.sparkSession.createDataFrame(words, "label string, token string")
        inner = tokens.filter("not inside").join(F.broadcast(listed), ["label", "token"]).groupBy("key", "label").agg(F.array_sort(F.collect_set("token")).alias("ws")).filter("size(ws) > 1")
        first = inner.select("label", "ws", F.posexplode("ws").alias("k", "a")).select("label", "a", F.explode(F.slice("ws", F.col("k") + 2, F.size("ws"))).alias("b"))
        single = tokens.filter("not inside").join(F.broadcast(listed), ["label", "token"]).groupBy("label", "token").agg(F.count("*").alias("n"))
        both = first.groupBy("label", "a", "b").agg(F.count("*").alias("n2"))
        both = both.join(single.withColumnsRenamed({"token": "a", "n": "na"}), ["label", "a"]).join(single.withColumnsRenamed({"token": "b", "n": "nb"}), ["label", "b"])
        for r in both.filter("n2 >= 3 and 10 * n2 >= 8 * na and 10 * n2 >= 8 * nb").select("label", "a", "b").collect():
            out[r["label"]].pairs.append((r["a"], r["b"]))
    for v in out.values():
        v.pairs.sort()
    return out
