"""Mapping freely typed values to the entries of a reference list.

Method: token-level repair. Values and reference names are folded into tokens; each distinct token of a value is joined
to the reference vocabulary: as it stands, as an abbreviation (the likelier the more of the word it holds), and, unless it is a
word of the vocabulary itself, within two edits found through shared deletion signatures. The repaired tokens are
combined by soft TF-IDF, which ranks the entries that they complete: those whose tokens and the value's cover each other, so that
another marker, state or number (which have tokens of their own and are never repaired) leaves a value unmatched. A token
may have several repairs, and a value several complete entries; the best score decides, if it is at least ``least``.

Defined results: null and blank values give no row; a value equal to a reference name, character for character, gives no
row unless ``keep_exact``; a value that means no entry gets -1; ties go to the smaller entry id; rows repeated under one
key give one row; an empty reference maps everything to -1; very long values are only tokenised, in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.runtime import cut, parts

#: Words that say something about a name but aren't part of it.
REMARKS = frozenset("cell cells population populations curated sensu lato stricto cf prob probable probably possible possibly likely putative approx rev revised cluster clust".split())
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: Letters that a token needs to be read as an abbreviation, or to be repaired; edits allowed.
MIN_PREFIX, MIN_REPAIR, EDITS = 3, 5, 2
_PREFIX_WINDOW = 8

_BRACKETS = re.compile(r"\((?!\s*\+)[^()]*\)|\[[^\[\]]*\]")
_CLUSTER = re.compile(r"^\W*(?:(?:cluster|clust|cl|c)\W*)?\d+(?:\s*[:_.)\-]|\s)\s*(?=\S)")
_MARKER = re.compile(r"\b([a-z][a-z0-9]*?)(?:\s*\(\s*\+\s*\)|\s*\+|[\s\-]*(?:positive|pos|high|hi)\b\.?)")
_GAMMA_DELTA = re.compile(r"\bgamma\W*delta\b|γ\W*δ|\bg\W?d\b")
_NUMBER = re.compile(r"(?:\b(?:no|nr|num|number)\b\.?|#|№)\s*(?=\d|[ivx]+\b)")
_TOKEN = re.compile(r"[^\W_]+\+?")


def tokens_of(value: str) -> list[str]:
    """Folded tokens: remarks, brackets and a leading cluster number dropped, markers end in +, Roman numbers as digits."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", value).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = _GAMMA_DELTA.sub(" gd ", _BRACKETS.sub(" ", s)).strip()
    while True:  # "prob. cluster 3: ..." in any order
        t = _CLUSTER.sub("", re.sub(r"^\W*(?:(?:cf|prob|probably|possibly|likely|putative)\b\.?)?\s*", "", s))
        if t == s:
            break
        s = t
    s = _NUMBER.sub(" ", _MARKER.sub(r" \1+ ", s.replace("_", " ")))
    found = [ROMAN.get(t, t) for t in _TOKEN.findall(s) if t not in REMARKS]
    return list(dict.fromkeys(found))


def signatures(token: str) -> list[str]:
    """The token's start with up to two letters deleted; tokens within two edits share one (also for a plural)."""
    out = set()
    for w in {token, token[:-1] if token.endswith("s") else token}:
        w = w[:_PREFIX_WINDOW]
        for k in range(EDITS + 1):
            for gone in combinations(range(len(w)), k):
                out.add("".join(c for i, c in enumerate(w) if i not in gone))
    return sorted(out)


def edits(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: insertions, deletions, substitutions and swaps, also around other edits."""
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1][1:] = range(len(b) + 1)
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_udf(values: pd.Series) -> pd.Series:
    return values.map(tokens_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _signatures_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(signatures)


@F.pandas_udf(T.IntegerType())
def _edits_udf(tokens: pd.Series, fixed: pd.Series) -> pd.Series:
    return pd.Series([min(edits(t, f), edits(t[:-1], f) if t.endswith("s") else 99) for t, f in zip(tokens, fixed)], dtype="int32")


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token) x (fixed) -> (token, fixed, sim): equal or plural 1, abbreviation 0.85 and up to 0.1 more, each edit 0.15 less than 1.

    A token may be an alias, an abbreviation of other words and a misspelling of yet others; words of the vocabulary are no misspellings.
    """
    words = F.col("token").rlike(r"^\p{L}+$")
    vocab = vocabulary.select("fixed").distinct()
    forms = tokens.select("token", F.explode(F.array_distinct(F.array("token", F.regexp_replace("token", "s$", "")))).alias("form"))
    exact = forms.join(vocab, forms["form"] == vocab["fixed"]).groupBy("token", "fixed").agg(F.lit(1.0).alias("sim"))
    exact = cut(exact)
    rest = tokens.where(words & (F.length("token") >= MIN_PREFIX))
    starts = vocab.where(F.col("fixed").rlike(r"^\p{L}+$")).select(
        "fixed", F.explode(F.expr(f"transform(sequence({MIN_PREFIX}, greatest({MIN_PREFIX}, length(fixed) - 1)), n -> substr(fixed, 1, n))")).alias("token")
    )
    short = cut(rest.join(starts, "token").where(F.length("token") < F.length("fixed")).select("token", "fixed", (0.85 + 0.1 * F.length("token") / F.length("fixed")).alias("sim")))
    rest = rest.join(exact, "token", "left_anti").where(F.length("token") >= MIN_REPAIR)
    signed = rest.repartition(parts(tokens.sparkSession), "token").select("token", F.explode(_signatures_udf("token")).alias("sig"))
    targets = vocab.where(F.col("fixed").rlike(r"^\p{L}+$") & (F.length("fixed") >= MIN_REPAIR)).select("fixed", F.explode(_signatures_udf("fixed")).alias("sig"))
    pairs = signed.join(targets, "sig").where(F.abs(F.length("token") - F.length("fixed")) <= EDITS + 1).select("token", "fixed").distinct()
    # a swap is two plain edits, an ending one more: what is farther than that needs no closer look
    pairs = pairs.where(F.levenshtein("token", "fixed", 2 * EDITS + 1) >= 0)
    near = pairs.withColumn("d", _edits_udf("token", "fixed")).where(F.col("d") <= EDITS)
    every = exact.unionByName(short).unionByName(near.select("token", "fixed", (1 - 0.15 * F.col("d")).alias("sim")))
    return every.groupBy("token", "fixed").agg(F.max("sim").alias("sim"))


def map_to_canonical(values: DataFrame, key: list[str], value: str, reference: DataFrame, entry: str, name: str, aliases: str | None = None, *, keep_exact: bool = False, least: float = 0.6) -> DataFrame:
    """One row (key..., value, entry id, score) for each non-blank ``value``; entry id -1 and score 0 where it means none."""
    asked = values.select(*(F.col(f"`{k}`") for k in key), F.col(f"`{value}`").alias("__value"))
    asked = asked.where(F.col("__value").rlike(r"(?U)[^\s]")).distinct()
    names = [F.col(f"`{name}`")]
    every = F.array(*names) if aliases is None else F.concat(F.array(*names), F.coalesce(F.col(f"`{aliases}`"), F.array().cast("array<string>")))
    ref = reference.select(F.col(f"`{entry}`").cast("int").alias("entry"), names[0].alias("name"), F.explode(every).alias("said")).where("said IS NOT NULL")
    if not keep_exact:
        asked = asked.join(ref.select(F.col("name").alias("__value")).distinct(), "__value", "left_anti")
    asked = cut(asked)
    forms = ref.groupBy("entry", "said").agg(F.lit(1).alias("n")).withColumn("words", _tokens_udf("said")).where(F.size("words") > 0)
    forms = cut(forms.select(F.monotonically_increasing_id().alias("form"), "entry", "words"))
    df = forms.select("form", F.explode("words").alias("fixed")).groupBy("fixed").agg(F.count("*").alias("df"))
    idf = cut(df.crossJoin(F.broadcast(forms.agg(F.count("*").alias("n")))).select("fixed", "df", F.log1p(F.col("n") / F.col("df")).alias("idf")))
    weighted = forms.select("form", "entry", "words", F.explode("words").alias("fixed")).join(idf, "fixed")
    entries = weighted.groupBy("form").agg(F.first("entry").alias("entry"), F.first("words").alias("words"), F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    block = entries.select("form", "entry", "words", "norm", F.explode("words").alias("fixed"))

    distinct = asked.select("__value").distinct().repartition(parts(values.sparkSession), "__value")
    said = cut(distinct.select("__value", _tokens_udf("__value").alias("tokens")))
    token = said.select("__value", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    fixes = cut(repair_tokens(token.select("token").distinct(), idf).join(idf, "fixed"))
    fixes = fixes.groupBy("token").agg(F.collect_list(F.struct("fixed", "sim", "idf")).alias("fixes"), F.max("df").alias("df"))
    found = token.join(fixes, "token").groupBy("__value").agg(
        F.first("n").alias("n"), F.count("*").alias("hit"), F.collect_list("fixes").alias("all_fixes"), F.min_by("fixes", F.struct("df", "token")).alias("rarest")
    )
    found = found.where("hit = n")  # a token that repairs to nothing belongs to no entry
    pairs = found.select("__value", "all_fixes", F.explode(F.transform("rarest", lambda f: f["fixed"])).alias("fixed")).join(block, "fixed")
    pairs = pairs.withColumn("use", F.transform("all_fixes", lambda fs: F.filter(fs, lambda f: F.array_contains("words", f["fixed"]))))
    pairs = pairs.where(F.forall("use", lambda u: F.size(u) > 0))
    best = F.transform("use", lambda u: F.array_max(F.transform(u, lambda f: F.struct(f["sim"].alias("sim"), f["idf"].alias("idf"), f["fixed"].alias("fixed")))))
    pairs = pairs.withColumn("use", best).where(F.size(F.array_except("words", F.col("use.fixed"))) == 0)
    total = lambda f: F.aggregate("use", F.lit(0.0), lambda a, u: a + f(u))
    score = total(lambda u: u["sim"] * u["idf"] * u["idf"]) / (F.col("norm") * F.sqrt(total(lambda u: u["idf"] * u["idf"])))
    ranked = pairs.select("__value", "entry", F.round(score, 9).alias("score")).where(F.col("score") >= least).groupBy("__value").agg(F.max(F.struct("score", (-F.col("entry")).alias("minus"))).alias("top"))
    ranked = ranked.select("__value", (-F.col("top.minus")).alias("__entry"), F.col("top.score").alias("__score"))
    out = asked.join(ranked, "__value", "left")
    return out.select(
        *(F.col(f"`{k}`") for k in key), F.col("__value").alias("value"), F.coalesce("__entry", F.lit(-1)).cast("int").alias("entry"), F.coalesce("__score", F.lit(0.0)).alias("score")
    )
