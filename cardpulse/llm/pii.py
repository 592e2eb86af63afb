"""Personal data: exact base kinds, and further spans chosen by gradient-boosted trees.

Every step over the texts is a DataFrame function. Base kinds are found by their patterns, written so that a run of characters is
entered once only (linear time also on long runs), and checked. High-recall generators then propose further, overlapping
spans; boosted trees over their format and context, compiled to CASE expressions, score them; per generator a threshold
calibrated on held-out labelled candidates selects. Positions are code points: the lengths between matches, summed up.

The work on a text is linear in its length and in the number of its matches, but for one sort: running sums are taken in chunks, the context of a
candidate is cut from the piece of text beside it, and overlaps are found by looking back from each span at the latest one of every kind, as
spans of a kind do not overlap.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns. A match begins where no earlier one could take its first character, so that lookbehinds
#: and possessive runs change nothing but the time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
_NEEDS = {"email": "@", "phone": "+"}
#: Generators of further candidates. A number ends with its last whole group: the start of a longer one after it is not taken.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+(])(?<![0-9][.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}(?![0-9A-Za-z]))++",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]{1,63}+(?:(?:\.| \. ?| ?[\[(] ?(?i:dot) ?[\])] ?)[A-Za-z0-9-]{1,63}+)++",
}
#: Code points of context on either side of a candidate.
CONTEXT = 24
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points of a block of text that is cut by position, and values of a chunk of a running sum.
BLOCK, CHUNK = 4096, 128
_SPAN = "array<struct<start:int,end:int,txt:string,before:string,after:string>>"


_numbers = itertools.count()


def _lambda(body: Callable[..., str], n: int) -> str:
    """A SQL lambda of ``n`` variables, with names of its own."""
    names = [f"v{next(_numbers)}" for _ in range(n)]
    return f"({', '.join(names)}) -> {body(*names)}" if n > 1 else f"{names[0]} -> {body(*names)}"


def _each(values: str, body: Callable[..., str], n: int = 1) -> str:
    return f"transform({values}, {_lambda(body, n)})"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once, however often the body, or a lambda in it, reads it."""
    return f"get({_each(f'array({value})', body)}, 0)"


Step = Callable[[str, str], str]


def _add(a: str, b: str) -> str:
    return f"({a} + {b})"


def _most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _fold(values: str, begin: str, step: Step) -> str:
    """What there is before each value of a short array: ``begin``, and what ``step`` makes of it and the values so far."""
    more = _lambda(lambda a, x: f"struct({step(f'{a}.at', x)} AS at, concat({a}.out, array({a}.at)) AS out)", 2)
    return f"aggregate({values}, struct({begin} AS at, cast(array() AS array<int>) AS out), {more}, {_lambda(lambda a: f'{a}.out', 1)})"


def _running(values: str, step: Step) -> str:
    """``_fold`` from 0 over an array of any length by an associative ``step``: over chunks, then within each."""

    def made(v: str) -> str:
        chunks = _each(f"sequence(0, int((size({v}) - 1) / {CHUNK}))", lambda k: f"slice({v}, {k} * {CHUNK} + 1, {CHUNK})")
        totals = lambda c: _each(c, lambda own: f"aggregate({own}, 0, {_lambda(step, 2)})")
        return _let(chunks, lambda c: f"flatten(zip_with({c}, {_fold(totals(c), '0', step)}, {_lambda(lambda own, begin: _fold(own, begin, step), 2)}))")

    return _let(values, lambda v: f"CASE WHEN size({v}) > {CHUNK} THEN {made(v)} ELSE {_fold(v, '0', step)} END")


def _located(matches: str, pieces: str) -> str:
    """Spans of the matches whose surrounding pieces are given, with up to CONTEXT code points before and after each (as far as the match beside it)."""

    def spans(m: str, p: str, at: str) -> str:
        def made(x: str, i: str) -> str:
            start = f"get({at}, {i}) + length(get({p}, {i}))"
            before = f"right(concat(coalesce(get({m}, {i} - 1), ''), get({p}, {i})), {CONTEXT})"
            after = f"left(concat(get({p}, {i} + 1), coalesce(get({m}, {i} + 1), '')), {CONTEXT})"
            return f"struct({start} AS start, {start} + length({x}) AS end, {x} AS txt, {before} AS before, {after} AS after)"

        return _each(m, made, 2)

    sizes = lambda m, p: _each(m, lambda x, i: f"length(get({p}, {i})) + length({x})", 2)
    return _let(matches, lambda m: _let(pieces, lambda p: _let(_running(sizes(m, p), _add), lambda at: spans(m, p, at))))


def _luhn(digits: Column) -> Column:
    """Does the string of digits pass the Luhn check?"""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(text))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _find(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds a column of spans for each pattern to (text, ...)."""
    names = {k: f"{k}_found" for k in patterns}
    none = F.lit(None).cast("array<string>")

    def all_of(kind: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))
        return F.when(F.contains("text", F.lit(_NEEDS[kind])), found).otherwise(none) if kind in _NEEDS else found

    df = df.withColumns({f"{k}_m": all_of(k) for k in patterns})
    df = df.withColumns({f"{k}_p": F.when(F.size(f"{k}_m") > 0, F.split("text", patterns[k], -1)).otherwise(none) for k in patterns})
    empty = F.lit(None).cast(_SPAN)
    df = df.withColumns({names[k]: F.coalesce(F.when(F.size(f"{k}_m") > 0, F.expr(_located(f"{k}_m", f"{k}_p"))).otherwise(empty), F.array().cast(_SPAN)) for k in patterns})
    return df.drop(*[f"{k}_{x}" for k in patterns for x in "mp"])


#: Features of a candidate, from its text and the context before and after it.
FEATURES = ("generator", "length", "digits", "letters", "marks", "groups", "brackets", "mixed", "hex", "cased", "quoted", "assigned", "says_phone", "says_id", "says_secret", "says_other", "money", "date", "valid_card", "decimal")


def _features(c: Column) -> dict[str, Column]:
    text, before, after = c["txt"], c["before"], F.substr(c["after"], F.lit(1), F.lit(8))
    low = F.lower(before)
    digits = _digits(text)

    def flag(x: Column) -> Column:
        return x.cast("int")

    return {
        "generator": c["generator"],
        "length": F.least(F.length(text), F.lit(99)),
        "digits": F.least(F.length(digits), F.lit(99)),
        "letters": F.least(F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.lit(99)),
        "marks": F.least(F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")), F.lit(99)),
        "groups": F.least(F.size(F.split(text, "[ .-]", -1)), F.lit(99)),
        "brackets": flag(text.rlike(r"[()\[\]]")),
        "mixed": flag(text.rlike("[0-9][A-Za-z]") & text.rlike("[A-Za-z][0-9]")),
        "hex": flag(text.rlike("^[0-9a-fA-F]+$")),
        "cased": flag(text.rlike("[a-z]") & text.rlike("[A-Z]")),
        "quoted": flag(before.rlike("[\"']$")),
        "assigned": flag(before.rlike("[=:] ?[\"']?$")),
        "says_phone": flag(low.rlike(r"(?:tel|phone|call|fax|mobile|cell|contact|whatsapp|teléfono|téléphone|telefon|ruf)[^0-9]{0,12}$")),
        "says_id": flag(low.rlike(r"(?:ssn|social security|passport|iban|account|konto|compte|cuenta|nif|dni|national id)[^0-9]{0,14}$")),
        "says_secret": flag(low.rlike(r"(?:token|secret|password|passwd|pwd|api.?key|key|bearer|auth|credential)[^0-9A-Za-z]{0,6}$")),
        "says_other": flag(low.rlike(r"(?:version|release|isbn|issn|order|invoice|page|section|chapter|figure|no\.|article|model|score|sha|commit|md5|build|id)[^0-9A-Za-z]{0,4}v?$")),
        "money": flag(before.rlike(r"[$€£] ?$") | after.rlike(r"^ ?(?:[$€£%]|USD|EUR|km|kg)")),
        "date": flag(text.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)?[0-9]{2})$")),
        "valid_card": flag(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)),
        "decimal": flag(text.rlike(r"^[0-9.]+$")),
    }


_PLACE = {name: k for k, name in enumerate(GENERATORS)}


def labelled_candidates(n: int = 1800, seed: int = 3) -> list[tuple[int, str, str, str, int]]:
    """(generator, text, before, after, label): candidates of common formats in common contexts, from a seed."""
    rng = random.Random(seed)

    def d(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def pick(alphabet: str, k: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(k))

    def filler(k: int = 3) -> str:
        return " ".join(pick("abdeilmnorstu", rng.randint(2, 8)) for _ in range(k))

    hexes, sixty_four = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sep = lambda: rng.choice(" .-")

    def phone() -> str:
        s = sep()
        return rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(2)}{s}{d(4)}{s}{d(4)}", f"0{d(1)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}"))

    says = lambda *w: f"{filler(1)} {rng.choice(w)}{rng.choice((': ', ' ', '. ', ' no '))}"
    plain = lambda: filler() + " "
    kinds = (
        (3, "number", lambda: (phone(), says("tel", "phone", "call", "fax", "mobile", "Telefon", "contact"), 1)),
        (2, "number", lambda: (f"({d(3)}) {d(3)}-{d(4)}", plain(), 1)),
        (1, "number", lambda: (f"{d(3)}-{d(3)}-{d(4)}", plain(), 1)),
        (2, "number", lambda: (f"{d(3)}-{d(2)}-{d(4)}", rng.choice((says("ssn", "social security"), plain())), 1)),
        (1, "number", lambda: ("-".join(d(4) for _ in range(rng.choice((3, 4)))), says("account", "passport", "Konto", "cuenta"), 1)),
        (3, "number", lambda: (rng.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}-{d(2)}-19{d(2)}")), plain(), 0)),
        (2, "number", lambda: (".".join(d(rng.choice((2, 2, 3))) for _ in range(rng.choice((3, 3, 4)))), says("version", "release", "section", "build"), 0)),
        (2, "number", lambda: (" ".join(d(rng.choice((2, 3))) for _ in range(rng.randint(3, 6))), plain(), 0)),
        (2, "number", lambda: (f"{d(2)} {d(3)} {d(3)}", rng.choice((plain() + "$", plain() + "€ ", plain())), 0)),
        (2, "number", lambda: ("-".join((f"978 {d(2)}", d(4), d(3))) if rng.random() < 0.5 else f"{d(4)}-{d(4)}-{d(2)}", says("isbn", "order", "invoice", "model"), 0)),
        (4, "secret", lambda: (pick(hexes, rng.choice((32, 40, 64))), rng.choice((f'{filler(1)} token = "', "secret: ", 'api_key="', "password = ", "Bearer ", "auth: ")), 1)),
        (3, "secret", lambda: (pick(sixty_four, rng.randint(20, 48)), rng.choice(("key = ", 'token: "', "pwd=", "credential: ")), 1)),
        (2, "secret", lambda: (rng.choice(("sk_", "ghp_", "AKIA", "xoxb-")) + pick(sixty_four, rng.randint(18, 36)), plain(), 1)),
        (3, "secret", lambda: (pick(hexes, rng.choice((32, 40, 64))), says("sha", "commit", "md5", "build"), 0)),
        (3, "secret", lambda: (filler(1) + "-" + filler(1) + "-" + filler(1) + d(1), plain(), 0)),
        (3, "secret", lambda: (pick("abdeilmnorstu", rng.randint(16, 24)) + d(rng.choice((1, 2))), plain(), 0)),
        (2, "secret", lambda: (d(rng.randint(16, 24)), plain(), 0)),
        (2, "secret", lambda: ("/" + filler(1) + "/" + filler(1) + "/" + filler(1) + d(2), plain(), 0)),
        (3, "handle", lambda: (f"{filler(1)} [at] {filler(1)} [dot] com" if rng.random() < 0.5 else f"{filler(1)}(at){filler(1)}.org", rng.choice((plain(), "mail: ")), 1)),
        (1, "handle", lambda: (f"{d(2)} (at) {d(2)}.{d(2)}", plain(), 0)),
    )
    deck = [k for k in kinds for _ in range(k[0])]
    out = []
    for _ in range(n):
        _, generator, make = rng.choice(deck)
        text, before, label = make()
        out.append((_PLACE[generator], text, before[-CONTEXT:], rng.choice((" ", '" ', ". ")) + filler(2), label))
    return out


#: A node is a leaf's value or (feature, bound, where not above, where above).
Tree = float | tuple[int, float, "Tree", "Tree"]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> list[Tree]:
    """Gradient-boosted regression trees on the logistic loss; their sum is a logit."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                cg, ch = np.cumsum(g[order]), np.cumsum(h[order])
                at = np.flatnonzero(x[order][1:, f] > x[order][:-1, f])
                if len(at):
                    gain = cg[at] ** 2 / (ch[at] + ridge) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + ridge) - total_g**2 / (total_h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, float(x[order[at[k]], f] + x[order[at[k] + 1], f]) / 2))
        if best[1] is None:
            return float(np.round(-rate * total_g / (total_h + ridge), 4))
        f, bound = best[1]
        low = x[rows, f] <= bound
        return f, bound, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1)

    out, z = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        z += predict([out[-1]], x)
    return out


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row."""

    def value(t: Tree, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(t, float):
            out[rows] += t
        else:
            low = x[rows, t[0]] <= t[1]
            value(t[2], rows[low], out)
            value(t[3], rows[~low], out)

    out = np.zeros(len(x))
    for t in trees:
        value(t, np.arange(len(x)), out)
    return out


def _compiled(trees: list[Tree], c: str) -> str:
    """The trees' sum as one SQL expression over a struct of FEATURES."""

    def node(t: Tree) -> str:
        return f"{t}D" if isinstance(t, float) else f"CASE WHEN {c}.{FEATURES[t[0]]} <= {t[1]}D THEN {node(t[2])} ELSE {node(t[3])} END"

    return " + ".join(["0D", *map(node, trees)])


Model = tuple[list[Tree], list[float]]


def fit_candidates(spark: SparkSession, rows: list[tuple[int, str, str, str, int]] | None = None, precision: float = 0.97) -> Model:
    """(trees, a logit threshold per generator): trees from two thirds of the labelled candidates, whose features the same expressions
    compute that score texts; each threshold is the lowest that keeps ``precision`` on the other third."""
    rows = labelled_candidates() if rows is None else rows
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, generator int, txt string, before string, after string, label int")
    c = F.struct("generator", "txt", "before", "after")
    made = frame.select("k", "label", *(f.cast("double").alias(name) for name, f in _features(c).items())).orderBy("k").collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in made]), np.array([r["label"] for r in made], dtype=float)
    train = np.arange(len(y)) % 3 != 0
    trees = boost(x[train], y[train])
    z, thresholds = predict(trees, x), []
    for g in range(len(GENERATORS)):
        own = ~train & (x[:, 0] == g)
        order = np.argsort(-z[own], kind="stable")
        hits = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= precision)
        thresholds.append(float(max(z[own][order][good[-1]] - 1e-9, 0.0)) if len(good) else float("inf"))
    return trees, thresholds


def _by_start(spans: str, other: str | None = None) -> str:
    """(start, end, kind, id, score) of numbered spans, by start; with spans (kind -1) of another array among them."""
    many = _each(spans, lambda c, i: f"struct({c}.start AS start, {c}.end AS end, {c}.generator AS kind, {i} AS id, {c}.score AS score)", 2)
    if other is not None:
        many = f"concat({many}, {_each(other, lambda b: f'struct({b}.start AS start, {b}.end AS end, -1 AS kind, -1 AS id, 0D AS score)')})"
    return f"array_sort({many})"


def _met(spans: str, places: list[str], s: str, i: str) -> str:
    """Of the spans at the i-th entries (from 1) of ``places``, those that reach into ``s``."""
    before = _each(f"array({', '.join(f'get({p}, {i})' for p in places)})", lambda j: f"get({spans}, {j} - 1)")
    return f"filter({before}, {_lambda(lambda o: f'{o} IS NOT NULL AND {o}.end > {s}.start AND {o}.kind <> {s}.kind', 1)})"


def _with_latest(spans: str, body: Callable[[str, list[str]], str]) -> str:
    """``body`` of spans and, for every generator, the place (from 1; 0 without any) of its latest span before each span."""

    def bind(s: str, rest: list[int], done: list[str]) -> str:
        if not rest:
            return body(s, done)
        latest = _running(_each(s, lambda x, i: f"CASE WHEN {x}.kind = {rest[0]} THEN {i} + 1 ELSE 0 END", 2), _most)
        return _let(latest, lambda p: bind(s, rest[1:], [*done, p]))

    return _let(spans, lambda s: bind(s, list(_PLACE.values()), []))


def _without(items: str, lost: str) -> str:
    """The items whose places (from 0) are not among the lost ones."""
    return _each(f"array_except(sequence(0, size({items}) - 1), {lost})", lambda i: f"get({items}, {i})")


def _clear_of(candidates: str, base: str) -> str:
    """The candidates that overlap no base span. Of two spans that overlap, that which begins later meets the other as the latest, or longest, before it."""

    def lost(spans: str, places: list[str]) -> str:
        ends = _running(_each(spans, lambda s: f"CASE WHEN {s}.kind < 0 THEN {s}.end ELSE 0 END"), _most)

        def each(reach: str) -> str:
            ids = lambda s, i: _each(_met(spans, places, s, i), lambda o: f"{o}.id")
            return _each(spans, lambda s, i: f"CASE WHEN {s}.kind < 0 THEN {ids(s, i)} WHEN get({reach}, {i}) > {s}.start THEN array({s}.id) ELSE cast(array() AS array<int>) END", 2)

        return f"flatten({_let(ends, each)})"

    return f"CASE WHEN size({candidates}) > 0 AND size({base}) > 0 THEN {_without(candidates, _with_latest(_by_start(candidates, base), lost))} ELSE {candidates} END"


def _unbeaten(candidates: str) -> str:
    """The candidates that overlap no better one: of higher score or, of equals, earlier by (start, kind)."""
    names = f"array({', '.join(repr(k) for k in _PLACE)})"
    tied = lambda o, s: f"{o}.score = {s}.score AND struct({o}.start, get({names}, {o}.kind)) < struct({s}.start, get({names}, {s}.kind))"

    def lost(spans: str, places: list[str]) -> str:
        loser = lambda s: lambda o: f"CASE WHEN {o}.score > {s}.score OR ({tied(o, s)}) THEN {s}.id ELSE {o}.id END"
        return f"flatten({_each(spans, lambda s, i: _each(_met(spans, places, s, i), loser(s)), 2)})"

    return f"CASE WHEN size({candidates}) > 1 THEN {_without(candidates, _with_latest(_by_start(candidates), lost))} ELSE {candidates} END"


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of each text: ``doc_id``, ``text`` (null: empty), the columns ``keep`` and ``found``, spans (kind, start, end) in code points: base kinds first as listed in
    BASE, then the generators' kinds, each by start; ``n_base`` of them are base spans. A base span always stays; a generated
    one counts if its score reaches its threshold and it overlaps no base span and no better generated one.
    One row for each row of ``docs``; ids may be null or repeat; other columns are ignored; an empty table gives an empty result. A very long
    text is one row's work, linear in its length and matches.
    """
    trees, thresholds = model or fit_candidates(docs.sparkSession)
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    df = _find(df, BASE | GENERATORS)
    span = "array<struct<kind:string,start:int,end:int>>"

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(span)

    def valid(kind: str):
        return lambda s: _valid(kind, s["txt"])

    df = df.withColumn("base", F.concat(*(named(k, F.filter(f"{k}_found", valid(k))) for k in BASE)))

    def candidate(kind: str):
        return lambda s: F.struct(F.lit(_PLACE[kind]).alias("generator"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["txt"].alias("txt"), s["before"].alias("before"), s["after"].alias("after"), F.lit(0.0).alias("score"))

    proposed = F.concat(*(F.transform(f"{k}_found", candidate(k)) for k in GENERATORS))
    df = df.withColumn("proposed", proposed)
    df = df.withColumn("candidates", F.expr(_let("proposed", lambda c: _let("base", lambda b: _clear_of(c, b)))))
    described = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *(f.alias(n) for n, f in _features(c).items())))
    df = df.withColumn("described", described)
    limits = f"array({', '.join(f'double({str(t)!r})' for t in thresholds)})"
    scored = _each("described", lambda c: f"struct({c}.kind AS kind, {c}.generator AS generator, {c}.start AS start, {c}.end AS end, {_compiled(trees, c)} AS score)")
    df = df.withColumn("scored", F.expr(f"filter({scored}, {_lambda(lambda c: f'{c}.score >= get({limits}, {c}.generator)', 1)})"))
    more = F.transform(F.expr(_let("scored", _unbeaten)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).cast(span)
    return df.select("doc_id", "text", *(F.col(f"kept_{c}").alias(c) for c in keep), F.concat("base", more).alias("found"), F.size("base").alias("n_base"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, of ``find_pii``'s rows."""
    base = F.slice("found", F.lit(1), F.col("n_base"))

    def of(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("found", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def redacted(text: str, spans: str) -> Column:
    """The column ``text`` with each of ``spans`` replaced by its kind in angle brackets; of spans that overlap, the earliest names the gap. The text is
    cut into blocks first, so that a piece between two spans is cut from a short string."""

    def piece(blocks: str, a: str, b: str) -> str:
        def cut(first: str, last: str) -> str:
            of = lambda k: f"coalesce(get({blocks}, {k}), '')"
            across = f"concat(substr({of(first)}, {a} % {BLOCK} + 1), array_join(slice({blocks}, {first} + 2, greatest({last} - {first} - 1, 0)), ''), substr({of(last)}, 1, {b} % {BLOCK}))"
            return f"CASE WHEN {first} = {last} THEN substr({of(first)}, {a} % {BLOCK} + 1, {b} - {a}) ELSE {across} END"

        return cut(f"int({a} / {BLOCK})", f"int({b} / {BLOCK})")

    def whole(s: str, blocks: str, done: str) -> str:
        named = _each(s, lambda x, i: f"CASE WHEN {x}.start < get({done}, {i}) THEN '' ELSE concat({piece(blocks, f'get({done}, {i})', f'{x}.start')}, '<', upper({x}.kind), '>') END", 2)
        end = f"array_max({_each(s, lambda x: f'{x}.end')})"
        return _let(end, lambda e: f"concat(array_join({named}, ''), {piece(blocks, e, f'greatest({e}, length({text}))')})")

    ordered = f"array_sort({_each(spans, lambda x: f'struct({x}.start AS start, {x}.end AS end, {x}.kind AS kind)')})"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"
    made = _let(ordered, lambda s: _let(blocks, lambda b: _let(_running(_each(s, lambda x: f"{x}.end"), _most), lambda d: whole(s, b, d))))
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {made} ELSE {text} END")
