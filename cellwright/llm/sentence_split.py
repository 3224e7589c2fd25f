"""Sentence boundaries across languages and scripts.

Method: structure first (block markup and blank lines separate; a line break separates unless the text is merely wrapped
there; list items start anew), then candidates: runs of stops, emoji or emoticons that end a sentence without a stop, and
blanks between Thai words. A maximum-entropy classifier (logistic regression of Spark ML over binary features, counted and
indexed by Spark: neighbouring tokens, case, length, digits, script) decides each candidate that isn't the end of its unit. It is
trained on reliable boundaries of a sample of at most about ``SAMPLE_DOCS`` distinct texts, drawn by their smallest document id, and of a few fixed
sentences, so that both kinds are always known: stops before a small letter are none, unambiguous stops and known
last words before known first words are. These words are counted in all distinct texts. Every training row is used with
and without its case, for texts typed in one case. All documents are split whole.

Defined results: offsets are code points, without white space around the sentence; null, empty and blank texts give no
rows, nor does text without any letter, digit or symbol; a document id that comes twice gives the rows of each delivery
once; an empty table gives no rows; very long texts take linear time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.runtime import cut, drop, parts, spread

SAMPLE_DOCS, MIN_ROWS = 20_000, 2

_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|table|tr|td|h[1-6]|hr|blockquote)\b[^<>]{0,200}>|\n[^\S\n]*\n\s*", re.I)
_ITEM = re.compile(r"[^\S\n]*(?:[-*+•·‣◦–—]|\(?\d{1,3}[.)]|[a-zA-Z][.)])[^\S\n]+(?=\S)")
_EMO = r"(?:[\U0001F000-\U0001FAFF☀-➿⭐⭕️‍]+|(?<![\w:;=])(?:[:;=][-^']?|8[-^'])[)(DPpOo/|*\]\[3]+(?![A-Za-z0-9])|\^_?\^|(?<!\w)<3|(?<!\w)T_T|(?<!\w)[xX]D(?!\w))"
_EMO_RE, _PICTURE = re.compile(_EMO), re.compile("[\U0001F000-\U0001FAFF☀-➿⭐⭕️‍]")
_STOP_SIGNS = ".!?…。！？｡؟۔।॥‽"
_STOPS = r"(?:[.!?…。！？｡؟۔।॥‽]|(?<=[Ͱ-Ͽἀ-῿])[;;])"
_CLOSERS = "\"'”’»)\\]」』）】›“*_"
_TAIL = rf"(?:[{_CLOSERS}]|\s*{_EMO}[.!?…]*)*"
_CAND = re.compile(rf"(?P<stop>{_STOPS}+(?:\s+(?=[!?…]){_STOPS}+)*){_TAIL}|{_EMO}(?:\s*{_EMO})*[.!?…{_CLOSERS}]*|(?<=[฀-๿])\s+(?=[฀-๿])")
_OPEN = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "«": "»", "‹": "›", "„": "“”", "“": "”"}
_MARKS = re.compile("[" + re.escape('"' + "".join(_OPEN) + "".join(_OPEN.values())) + "]")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
#: What follows a stop: blanks, signs that open, the next word.
_NEXT = re.compile(r"(\s*)([\"'“„«‹(\[「『（【¿¡*_\-–— ]*)([^\W_]*(?:['’\-][^\W_]+)*)")
_NUMBER_UNIT = re.compile(r"\d[.,\d]*[^\W\d_]{1,4}")
_BEFORE_WORD = frozenset("([{«“„\"「『（")
#: Abbreviations that are followed by what they belong to.
BOUND = frozenset(
    "mr mrs ms dr prof st sr sra srta rd co no nos nr vs approx ca incl inkl e.g i.e cf ch rev hrs min fig vol pp p s sec art art.-nr z.b d.h bzw vgl hrn fr "
    "z d u gl avda evtl ggf m mme mlle réf ref env pág pag p.ej aprox núm n.º ee uu dña d.ª стр см рис прибл арт им тыс руб г ул т тр μ κ βλ σελ περ ελ π.χ ص د नं डॉ रा รศ ดร".split()
)
_JOINS = ("と", "って", "라고", "라며", "하고", "이라고", "고 ", "라는")
_FULL = frozenset("!?。！？｡؟۔।॥‽;;")
#: Always part of the training texts.
_PRIMER = (
    "The lid fits well. It was shut by two of us! Did it hold? Yes, it did.\nWe paid 3.50 for it, i.e. less than before. Mr. Untel saw e.g. the second one. It is fine.",
    "Das ist gut. Es kostet ca. 5 Euro. Wir sind zufrieden! Ist es neu? Ja.",
)


_HEAD = re.compile(r"[⺀-鿿぀-ヿ＀-￯]|[^\s⺀-鿿぀-ヿ＀-￯]+")


def _head(nxt: str) -> str:
    """The part of the next line that a wrapped text could not put on the line before."""
    m = _HEAD.match(nxt.lstrip())
    return m.group() if m else ""


def _width(blocks) -> int:
    """The column at which the text is wrapped, 0 if it isn't: most line breaks come where the next word has no room."""
    breaks = []
    for lines in blocks:
        for x, y in zip(lines, lines[1:]):
            if x.strip() and y.strip():
                n, head = len(x.rstrip()), _head(y)
                breaks.append((n, n + (1 if _script(head[:1]) in ("han", "kana") else 1 + len(head)), n >= (10 if _script(head[:1]) in ("han", "kana") else 20)))
    # a break agrees with widths from its line's length to what the next word would have needed; lines shorter than any page don't count
    ends = sorted((w, d) for n, full, wide in breaks if wide and full > n for w, d in ((n, 1), (full, -1)))
    best = most = hits = 0
    for w, d in ends:
        hits += d
        if hits > max(most, 1):
            best, most = w, hits
    return best if 2 * most >= len(breaks) and (best >= 38 or 4 * most >= max(12, 3 * len(breaks))) else 0  # narrow columns by chance are common


def _wrapped(line: str, nxt: str, width: int, cased: bool) -> bool:
    """Whether the text runs on from ``line`` to ``nxt``."""
    word = _head(nxt)
    if not word or not line.strip() or _ITEM.match(nxt):
        return False
    if width:
        return len(line.rstrip()) + 1 + len(word) > width
    return cased and word[0].islower() and not re.search(rf"{_STOPS}\W*$", line)


def units(text: str):
    """(start, end) of the stretches that no sentence crosses."""
    at, blocks = 0, []
    for m in _BLOCK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    lines = [(a, text[a:b].split("\n")) for a, b in blocks]
    width, cased = _width([ls for _, ls in lines]), _cased(text)
    for a, ls in lines:
        start = pos = a
        for i, line in enumerate(ls):
            pos += len(line) + 1
            if i + 1 == len(ls) or not _wrapped(line, ls[i + 1], width, cased):
                yield start, pos - 1
                start = pos


def _spans(s: str):
    """Matched quotes and brackets, outermost only, as bounds; a straight quote opens where a word begins and closes where one ends."""
    if not _MARKS.search(s):
        return []
    free = bytearray(len(s))
    for m in _EMO_RE.finditer(s):
        free[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out, stack, awaited, straight = [], [], {}, -1
    for m in _MARKS.finditer(s):
        i = m.start()
        if free[i]:
            continue
        c = s[i]
        if c == '"':
            if straight >= 0 and i and not s[i - 1].isspace():
                out.append((straight, i))
                straight = -1
            elif not s[i + 1 : i + 2].isspace() and not s[i - 1 : i].isalnum():
                straight = i
            continue
        if awaited.get(c):  # inner ones that were never closed are none
            while True:
                at, closers = stack.pop()
                for x in closers:
                    awaited[x] -= 1
                if c in closers:
                    break
            out.append((at, i))
        elif c in _OPEN:
            stack.append((i, _OPEN[c]))
            for x in _OPEN[c]:
                awaited[x] = awaited.get(x, 0) + 1
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


_DIGITS, _INITIALS = re.compile(r"[\d.,:]+"), re.compile(r"(?:\w\.)*\w")


def _norm(word: str) -> str:
    """A token as the classifier knows it: small letters, digits masked, the last signs only where words aren't spaced."""
    low = re.sub(r"\d+", "0", word.lower())
    return low[-2:] if _script(low[-1:]) in ("han", "kana") else low[-6:] if _script(low[-1:]) == "thai" else low


def _first(word: str) -> str:
    low = re.sub(r"\d+", "0", word.lower())
    return low[:2] if _script(low[:1]) in ("han", "kana") else low[:4] if _script(low[:1]) == "thai" else low


def _script(c: str) -> str:
    o = ord(c) if c else 0
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    for name, low, high in (("greek", 0x370, 0x3FF), ("cyr", 0x400, 0x52F), ("arab", 0x600, 0x6FF), ("deva", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hang", 0xAC00, 0xD7AF)):
        if low <= o <= high:
            return name
    return "latin" if c.isalpha() else "other"


def _case(c: str) -> str:
    return "U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" if c.isalpha() else "p" if c else "-"


def _token_before(s: str, i: int) -> int:
    """Where the token ends at ``i`` begins: at a blank, an opening sign or a full stop of another script, or three dots back."""
    dots, j = 0, i
    while j and not s[j - 1].isspace() and s[j - 1] not in _BEFORE_WORD and s[j - 1] not in _FULL:
        dots += s[j - 1] == "."
        if dots > 3:
            break
        j -= 1
    return j


def candidates(s: str):
    """(begin, end, stop, last, sign, gap, next word, head, opened, tail, more, joined) of every place in unit ``s`` where a sentence may end."""
    spans, k, size = _spans(s), 0, len(s.rstrip())
    item = _ITEM.match(s)
    first = item.end() if item else 0
    for m in _CAND.finditer(s, first):
        start, end = m.span()
        if end >= size:
            break  # the end of the unit ends it
        while k < len(spans) and spans[k][1] < start:
            k += 1
        if k < len(spans) and spans[k][0] < start and end <= spans[k][1]:
            continue  # inside quotes or brackets
        stop = m.group("stop") or ""
        n = _NEXT.match(s, end)
        at = n.end(1)
        gap = "s" if at > end or (not stop and m.group().isspace()) else ""
        j = _token_before(s, start)
        last = s[j:start].strip("\"'“„«»”’*_")
        head = s[n.end(2) : n.end(2) + 1]
        if len(last) == 1 and last.isalpha() and head.isalpha() and s[n.end(2) + 1 : n.end(2) + 2] == ".":
            more = "i"
        else:
            while j and s[j - 1].isspace():
                j -= 1
            more = "u" if (0 < len(last) <= 4 and last.isalpha() and s[j - 1 : j].isdigit()) or _NUMBER_UNIT.fullmatch(last) else ""
        yield start, end, stop or m.group().strip()[:1], last, s[at : at + 1], gap, n.group(3), head, n.end(2) - at, end - start - len(stop), more, s.startswith(_JOINS, at)


def _tokens(last: str, word: str, starters, finals, memo: dict):
    """What the features need to know of the tokens on both sides."""
    key = (last, word)
    if key not in memo:
        if len(memo) > 100_000:
            memo.clear()
        low, nxt = _norm(last), _first(word)
        known = ("S" if nxt in starters else "s") + ("F" if low in finals else "f") + ("B" if low in BOUND or _INITIALS.fullmatch(low) and not low.isdigit() else "b")
        shape = "num" if _DIGITS.fullmatch(low) else "dot" if "." in low else "len" + str(min(len(low), 6))
        memo[key] = (low, nxt, known, shape, _script(low[-1:]), len(last) == 1 and last.isupper() and low in BOUND)
    return memo[key]


def features(c, cased: bool, starters, finals, memo: dict) -> list[str]:
    _, _, stop, last, sign, gap, word, head, opened, tail, more, _ = c
    low, nxt, known, shape, script, title = _tokens(last, word, starters, finals, memo)
    kind = stop[:1] + (">1" if len(stop) > 1 else "")
    case = (_case(head) if cased else _case(head.lower()).replace("l", "?")) + ("q" if opened else "")
    lead = sign if sign and sign in ",;:-–—)»”" else ""
    names = [
        f"k{kind}", f"kg{kind}|{gap}", f"c{case}|{kind}|{gap}", f"kn{known}|{kind}", f"knc{known}|{case}|{gap}", f"l{low}", f"lc{low}|{case}", f"n{nxt}", f"sh{more or shape}|{case}|{known[0]}",
        f"sc{script}|{_script(head)}|{kind}|{gap}", f"tail{tail > 0}|{case}|{gap}",
    ]
    if lead:
        names.append(f"lead{lead}|{kind}")
    if title and cased:
        names.append(f"t|{case}|{kind}")  # "M. Untel" isn't "1,70 m. El"
    return names


def label(c, starters, finals):
    """1 or 0 where the case is reliable, else None."""
    _, _, stop, last, sign, gap, word, head, opened, tail, more, joined = c
    low, nxt = _norm(last), _first(word)
    case, script = _case(head), _script(low[-1:])
    ascii_stop = stop[:1] in ".!?…" and stop[:1] != ""
    spaced = script not in ("han", "kana", "thai")
    if sign and sign in ",;:)»”" or more == "i":
        return 0
    if joined and not gap:
        return 0
    if len(last) == 1 and last.isupper() and low in BOUND and stop == "." and gap and case == "U":
        return 0
    if case == "l" and (gap or spaced) and (ascii_stop or not stop.strip()):
        return 0
    if script == "thai" and not stop.strip():
        return 1 if nxt in starters and low in finals else 0 if nxt not in starters and low not in finals else None
    if stop[:1] in _FULL and (gap or not ascii_stop or case in "Uo" or not spaced):
        return 1
    number = re.fullmatch(r"[\d.,:]+", low)
    if stop[:1] in ".…":
        if not gap:
            if not spaced and low in finals:
                return 1
            if case == "d" or number or len(low) < 2 and not more:
                return 0
            return 1 if case == "U" and (len(low) >= 4 or more) and last.isalpha() and not last.isupper() or low in finals and case == "o" else None
        if nxt in starters and (number or more == "u") and case in "Uod":
            return 1 if low not in BOUND or low in finals else 0
        if low in BOUND and low not in finals and case in "Udo":
            return 0
        if low in finals and (nxt in starters or case == "d"):
            return 1
        if tail == 0 and len(low) >= 4 and last.isalpha() and (case == "o" or case == "U" and low in finals):
            return 1  # long words are seldom short for something
        if low not in finals and nxt not in starters and (len(low) <= 7 and case in "dU" or len(low) <= 3 or number):
            return 0
    if not stop.strip() or _EMO_RE.match(stop):
        return 1 if case in "Uo" else None
    return None


def _cased(text: str) -> bool:
    up, low = sum(map(str.isupper, text)), sum(map(str.islower, text))
    return up == 0 == low or (up > 0 and low > up)


def split(text: str, weights: dict, starters, finals, memo: dict | None = None):
    """(start, end) of the sentences of ``text``; ``weights`` per feature, with the intercept under the empty name."""
    memo, cased, bias = {} if memo is None else memo, _cased(text), weights[""]
    for a, b in units(text):
        s = text[a:b]
        at = 0
        for c in candidates(s):
            so_far = s[at : c[0]]
            if not any(map(str.isalnum, so_far)):
                continue  # nothing said yet
            if c[2][:1] in ".…" and len(c[2]) + c[2].count("…") > 1 and sum(map(str.isalpha, so_far)) <= 4 and len(_WORD.findall(so_far)) <= 1:
                continue  # an interjection that trails off begins the sentence
            if sum(weights.get(n, 0.0) for n in features(c, cased, starters, finals, memo)) + bias <= 0:
                continue
            yield from _trim(text, a + at, a + c[1])
            at = c[1]
        yield from _trim(text, a + at, b)


def _trim(text, a, b):
    s = text[a:b]
    lead = len(s) - len(s.lstrip())
    if lead < len(s):
        yield a + lead, a + len(s.rstrip())


def _words_at_ends(batches):
    """Words that begin and that end stretches which are ended by structure."""
    from collections import Counter

    for batch in batches:
        seen: Counter = Counter()
        for text in batch["text"].to_pylist():
            for a, b in units(text):
                s = text[a:b].strip()
                s = s[m.end() :] if (m := _ITEM.match(s)) else s
                w = _NEXT.match(s)
                if w.group(3):
                    seen["s", _first(w.group(3))] += 1
                e = len(s)
                while e and (s[e - 1] in _CLOSERS or s[e - 1].isspace() or _PICTURE.match(s, e - 1)):
                    e -= 1
                at = len(s[:e].rstrip(_STOP_SIGNS))
                word = s[_token_before(s, at) : at].strip("\"'“„«»”’*_") if at < e or _script(s[-1:]) == "thai" else ""
                if word:
                    seen["f", _norm(word)] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["side", "word", "n"])


def _labelled(starters, finals):
    def run(batches):
        memo: dict = {}
        for batch in batches:
            ys, xs = [], []
            for text in batch["text"].to_pylist():
                if not _cased(text):
                    continue
                for a, b in units(text):
                    for c in candidates(text[a:b]):
                        y = label(c, starters, finals)
                        if y is not None:
                            for cased in (True, False):
                                ys.append(float(y))
                                xs.append(features(c, cased, starters, finals, memo))
            if ys:
                yield pa.RecordBatch.from_arrays([pa.array(ys), pa.array(xs, pa.list_(pa.string()))], ["label", "names"])

    return run


def _sample(texts: DataFrame, sample_docs: int, seed: int) -> tuple[DataFrame, int]:
    """(about ``sample_docs`` of the distinct texts (text, id) at most, drawn by a hash of the id; how many distinct texts there are)."""
    n = texts.count()
    share = min(1.0, sample_docs / max(1, n))
    return texts.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))), n


def train(docs: DataFrame, id_col: str, text: str, sample_docs: int = SAMPLE_DOCS, seed: int = 3):
    """(weights, starters, finals): words counted in all distinct texts, weights from at most about ``sample_docs`` of them.

    A word counts from 2 occurrences on, or from that rate in ``sample_docs`` texts, which also bounds the number of words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = cut(texts.groupBy("text").agg(F.min("id").alias("id")).repartition(parts(spark)))
    some, n = _sample(texts, sample_docs, seed)
    least = max(2.0, 2.0 * n / sample_docs)
    ends = texts.select("text").mapInArrow(_words_at_ends, "side string, word string, n long").groupBy("side", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    starters, finals = (frozenset(r.word for r in ends if r.side == k) for k in "sf")
    finals = frozenset(w for w in finals if not _DIGITS.fullmatch(w))
    read = some.select("text").unionByName(spark.createDataFrame([(t,) for t in _PRIMER], "text string")).repartition(parts(spark))
    rows = cut(read.mapInArrow(_labelled(starters, finals), "label double, names array<string>"))
    drop(texts)
    counter = CountVectorizer(inputCol="names", outputCol="features", binary=True, minDF=MIN_ROWS, vocabSize=1 << 20).fit(rows)
    fit = LogisticRegression(maxIter=50, regParam=1e-5, standardization=False).fit(counter.transform(rows).select("label", "features"))
    drop(rows)
    weights = {w: float(x) for w, x in zip(counter.vocabulary, fit.coefficients.toArray()) if x}  # bounded by the sample
    return weights | {"": float(fit.intercept)}, starters, finals


def sentences(docs: DataFrame, id_col: str, text: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence; see the module's text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, id_col, text, sample_docs))

    def run(batches):
        memo: dict = {}
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                for a, b in split(t, *model.value, memo):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "sent_start", "sent_end"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    out = spread(rows, parts(spark, 4), F.xxhash64("id")).mapInArrow(run, "id long, sent_start int, sent_end int")
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()  # texts don't move for this
    return out if unique else out.distinct()
