"""Style measures of texts, made by one kernel over batches of texts (`operators.style` names them and says what each is)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .text import BLANKS

#: Characters that are taken at a time, whatever the batch.
_CHARS = 1 << 17
_WORDS = {k: p.split("|") for k, p in {**V.DENSITIES, **V.DIALOGUE_DENSITIES}.items() if "[" not in p and "\\" not in p}
_WORDED = [k for k in V.DENSITIES if k in _WORDS and k != "破折号密度"] + ["对白第二人称密度"]
_NUMERALS = "零一二三四五六七八九十百千万亿"
_CJK, _SENTENCE, _CLAUSE, _OPEN, _CLOSE, _DASH, _DOTS, _DOT, _NUMERAL, _DIGIT, _EXCLAIM, _PARTICLE, _CLOSING, _BLANK, _RULED = (1 << i for i in range(15))
_FIRST = {k: 1 << (15 + i) for i, k in enumerate(_WORDED)}
STYLE = ["句均字", "句p90", "长句率", "短句率", "句长CV", "分句均字", "段均字", "段p90字", "段均句数", "单句段占比", "对话段占比", "对话字占比", *V.DENSITIES]
TYPE = "struct<cjk:int,checked:boolean,dialogue_checked:boolean,style:array<double>,dialogue:array<double>>"


@lru_cache(maxsize=2)
def _tables(through: tuple[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(what each code point is taken for, the classes of each code point)."""
    code = np.arange(0x110000, dtype=np.uint32)
    for a, b in reversed(list(zip(*through))) if through else ():  # of a letter named twice the first counts
        code[ord(a)] = ord(b)
    of = np.zeros(len(code), np.uint32)
    of[0x3400:0x4DC0] |= _CJK
    of[0x4E00:0xA000] |= _CJK
    for marks, bit in (("。！？", _SENTENCE), ("，、；：。！？\n", _CLAUSE), ("「“", _OPEN), ("」”", _CLOSE), ("—―", _DASH), ("…", _DOTS), (".", _DOT), (_NUMERALS, _NUMERAL),
                       ("0123456789", _DIGIT), ("！!", _EXCLAIM), (V.DENSITIES["语气词密度"][1:-1], _PARTICLE), (V.PARAGRAPH_MARKS, _CLOSING), (BLANKS, _BLANK), ("=-_*#~" + BLANKS, _RULED)):
        of[[ord(x) for x in marks]] |= np.uint32(bit)
    for k in _WORDED:
        of[sorted({ord(w[0]) for w in _WORDS[k]})] |= np.uint32(_FIRST[k])
    return code, of


def _apart(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of matches that are left when each begins where the one before has ended at the earliest."""
    if not len(at) or not (at[:-1] + length[:-1] > at[1:]).any():
        return at
    out, end = [], -1
    for a, n in zip(at.tolist(), length.tolist()):
        if a >= end:
            out.append(a)
            end = a + n
    return np.array(out, np.int64)


def _words(c: np.ndarray, at: np.ndarray, words: list[str]) -> np.ndarray:
    """Where one of the words is found (of two at one place the one that is named first)."""
    length = np.zeros(len(at), np.int64)
    for w in reversed(words):
        hit = c[at] == ord(w[0])
        for i, x in enumerate(w[1:], 1):
            hit[hit] = c[at[hit] + i] == ord(x)
        length[hit] = len(w)
    return _apart(at[length > 0], length[length > 0])


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of adjacent places."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[first], np.diff(np.append(first, len(at)))


def _repeated(at: np.ndarray, n: int) -> np.ndarray:
    """The first place of each n of a run of places (what is left of the run is none)."""
    first, length = _runs(at)
    return np.repeat(first, length // n)


def _readings(c: np.ndarray, numerals: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Two numerals or more in a row; numbers of digits, with a decimal part if one follows."""
    first, length = _runs(numerals)
    start, size = _runs(digits)
    linked = np.zeros(len(start), bool)
    if len(start):
        linked[1:] = (start[1:] == start[:-1] + size[:-1] + 1) & (c[start[1:] - 1] == ord("."))
    head = np.flatnonzero(~linked)
    place = np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(start))))
    return np.concatenate([first[length >= 2], start[place % 2 == 0]])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def _paragraph_ends(of: np.ndarray, feeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends (places of line feeds) of the paragraphs: lines joined until one ends with a closing mark or they are long enough; ruled and blank lines are none."""
    full = np.flatnonzero(~(of & _BLANK).astype(bool))
    stops = feeds[1:]
    low, high = np.searchsorted(full, feeds[:-1]), np.searchsorted(full, stops)
    some = low < high
    first, last, stops = full[low[some]], full[high[some] - 1], stops[some]
    length = last - first + 1
    plain = np.append(0, np.cumsum(~(of & _RULED).astype(bool)))
    kept = (length < 4) | (plain[last + 1] > plain[first])
    last, length, stops = last[kept], length[kept], stops[kept]
    closing, final = (of[last] & _CLOSING).astype(bool), np.diff(np.searchsorted(bounds, stops), append=-1) != 0
    ends, held = np.zeros(len(stops), bool), 0
    for i, (n, c, f) in enumerate(zip(length.tolist(), closing.tolist(), final.tolist())):
        held += n
        if c or f or held >= V.PARAGRAPH_CHARS:
            ends[i], held = True, 0
    return stops[ends]


def _of(texts: list[str], through: tuple[str, str] | None) -> tuple[np.ndarray, ...]:
    """cjk, checked, dialogue_checked, style, dialogue of each text."""
    table, classes = _tables(through)
    # A line feed stands before, between and after texts, so nothing that is counted goes beyond one.
    c = table[np.frombuffer(("\n" + "\n".join(texts) + "\n" * 8).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of, m = classes[c], len(texts)
    bounds = np.append(0, np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, m)))  # the feeds around texts
    c[bounds], of[bounds] = 10, classes[10]
    where = lambda bit: np.flatnonzero(of & np.uint32(bit))
    text_of = lambda at: np.searchsorted(bounds, at) - 1  # noqa: E731  (of places and of ends: an end belongs to the text before it)
    per = lambda at, weights=None: np.bincount(text_of(at), weights, m).astype(np.float64) if len(at) else np.zeros(m)
    upto = np.append(0, np.cumsum(of & _CJK))  # CJK letters before a place
    cjk = np.diff(upto[bounds]).astype(np.float64)

    def pieces(ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, CJK letters) of what lies between ends, if it has so many."""
        n = np.diff(upto[ends], prepend=0)
        return ends[n >= least], n[n >= least]

    def rank(at: np.ndarray, n: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The value at nine tenths of the sorted values of each text."""
        ordered = n[np.lexsort((n, text_of(at)))]
        place = np.cumsum(count) - count + np.rint(0.9 * np.maximum(count - 1, 0))
        return np.append(ordered, 0)[np.minimum(place, len(ordered)).astype(np.int64)].astype(np.float64)

    feeds = np.flatnonzero(c[: bounds[-1] + 1] == 10)
    paras = _paragraph_ends(of, feeds, bounds)
    para_of = lambda at: np.searchsorted(paras, at)
    n_paras = per(paras)
    s_at, s = pieces(np.union1d(where(_SENTENCE), np.union1d(paras, bounds)), 2)
    k_at, k = pieces(where(_CLAUSE), 2)
    p = np.diff(upto[paras], prepend=0)
    sents = np.bincount(para_of(s_at), minlength=len(paras)) if len(s) else np.zeros(len(paras), np.int64)
    n_s, sum_s, n_k = per(s_at), per(s_at, s), per(k_at)
    mean_s = _ratio(sum_s, n_s)
    spread = np.sqrt(np.maximum(0.0, _ratio(per(s_at, s * s), n_s) - mean_s**2))

    # Quotes go from the first opening mark after a quote to the next closing one.
    marks = where(_OPEN | _CLOSE)
    opening = (of[marks] & _OPEN).astype(bool)
    own, mine = text_of(marks), para_of(marks)
    same, alike = np.diff(own, prepend=-1) == 0, np.diff(mine, prepend=-1) == 0
    after = np.append(False, opening[:-1])  # the mark before is an opening one
    start, stop = marks[opening & ~(after & same)], marks[~opening & after & same]
    start = start[np.searchsorted(start, stop) - 1] if len(stop) else start[:0]
    talked = np.unique(mine[~opening & after & alike])
    q = upto[stop] - upto[start]
    said_in = per(stop, q)
    start, stop, q = start[q >= 1], stop[q >= 1], q[q >= 1]

    def quoted(at: np.ndarray) -> np.ndarray:
        """The quote each place lies in, or -1."""
        i = np.searchsorted(start, at) - 1
        return np.where((i >= 0) & (at < np.append(stop, -1)[i]), i, -1)

    dashes = where(_DASH)
    long_dashes = dashes[c[dashes] == 0x2014]
    first, length = _runs(long_dashes)
    found = {name: _words(c, where(bit), _WORDS[name]) for name, bit in _FIRST.items()}
    found["破折号密度"] = np.concatenate([np.repeat(first, (length + 1) // 2), dashes[c[dashes] != 0x2014]])
    found["叹号密度"], found["语气词密度"] = where(_EXCLAIM), where(_PARTICLE)
    found["省略号密度"] = np.concatenate([_repeated(where(_DOTS), 2), _repeated(where(_DOT), 3)])
    found["数字读数密度"] = _readings(c, where(_NUMERAL), where(_DIGIT))

    style = [
        mean_s, rank(s_at, s, n_s), _ratio(per(s_at[s > 30]), n_s), _ratio(per(s_at[s <= 8]), n_s), _ratio(spread, mean_s), _ratio(per(k_at, k), n_k),
        _ratio(per(paras, p), n_paras), rank(paras, p, n_paras), _ratio(per(paras, sents), n_paras), _ratio(per(paras[sents <= 1]), n_paras), _ratio(per(paras[talked[talked < len(paras)]]), n_paras),
        _ratio(said_in, cjk), *[_ratio(per(found[name]), cjk) * 1000 for name in V.DENSITIES],
    ]
    n_q, said = per(stop), per(stop, q)
    dashed = np.unique(quoted(dashes))
    you = found["对白第二人称密度"]
    talk = {
        "对白破折号占比": _ratio(per(stop[dashed[dashed >= 0]]), n_q),
        "对白条数每千字": _ratio(n_q, cjk) * 1000,
        "对白第二人称密度": _ratio(per(you[quoted(you) >= 0]), said) * 1000,
        "对白句均字": _ratio(said, n_q),
    }
    least = V.DIALOGUE_MINIMA
    checked = (cjk >= V.STYLE_CHARS) & (n_paras >= 3) & (n_s >= 5)
    talks = (n_paras >= least["paragraphs"]) & (n_q >= least["quotes"]) & (cjk >= least["chars"]) & (said >= least["quoted"])
    return cjk.astype(np.int32), checked, talks, np.stack(style, 1), np.stack([talk[x] for x in V.DIALOGUE_RULES], 1)


def _lists(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    """The rows of values as lists; of rows that aren't ok, lists of nulls."""
    flat = pa.array(values.ravel(), mask=np.repeat(~ok, values.shape[1]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _kernel(through: tuple[str, str] | None):
    def run(texts: pa.Array) -> pa.Array:
        parts, held, chars = [], [], 0
        for x in texts:
            held.append(x.as_py() or "")
            chars += len(held[-1])
            if chars >= _CHARS:
                parts.append(_of(held, through))
                held, chars = [], 0
        if held or not parts:
            parts.append(_of(held or [""], through))
        cjk, checked, talks, style, talk = (np.concatenate(x)[: len(texts)] for x in zip(*parts))
        arrays = [pa.array(cjk), pa.array(checked), pa.array(talks), _lists(style, checked), _lists(talk, talks)]
        return pa.StructArray.from_arrays(arrays, ["cjk", "checked", "dialogue_checked", "style", "dialogue"], mask=texts.is_null() if texts.null_count else None)

    return run


def _paragraphs(text: str):
    held = ""
    for line in text.split("\n"):
        x = line.strip(BLANKS)
        if x and (len(x) < 4 or x.strip("=-_*#~" + BLANKS)):
            held += x
            if x[-1] in V.PARAGRAPH_MARKS or len(held) >= V.PARAGRAPH_CHARS:
                yield held
                held = ""
    if held:
        yield held


_LETTERS, _CLAUSES = re.compile(V.CJK_STYLE), re.compile(f"[^{V.CLAUSE_MARKS}]+")
_OTHER, _ENDS = re.compile(f"[^{V.CJK_STYLE[1:-1]}{V.SENTENCE_MARKS}]+"), re.compile(f"[{V.SENTENCE_MARKS}]")
_SHOWN = {k: re.compile({**V.DENSITIES, **V.DIALOGUE_DENSITIES}[k]) for k in ("破折号密度", "身体外化密度", "对白第二人称密度")}


def _piece(metric: str, text: str, paras: list[str], quotes: list[str]) -> str:
    """As `operators.style.evidence` gives it."""
    several = lambda n: (p for p in paras if sum(len(x) >= 2 for x in _ENDS.split(_OTHER.sub("", p))) >= n)
    said = lambda pattern: next((f"「{q}」"[:60] for q in quotes if pattern.search(q)), "")
    if metric in ("对白破折号占比", "对白第二人称密度"):
        return said(_SHOWN["破折号密度" if metric == "对白破折号占比" else metric])
    if metric == "对白条数每千字":
        return f"（全章引号台词 {len(quotes)} 条）"
    if metric in ("破折号密度", "身体外化密度"):
        return next((p[:60] for p in paras if _SHOWN[metric].search(p)), "")
    if metric == "段均句数":
        return next(several(3), "")[:60]
    if metric == "段p90字":
        n, p = max(((len(_LETTERS.findall(p)), p) for p in several(2)), key=lambda x: x[0], default=(0, None))
        return "（整章没有一个两句话以上的段落，长段被全部删掉）" if p is None else f"（最长多句段只有 {n} 字）{p[:50]}"
    if metric == "单句段占比":
        return "（整章多数段落是多句连排，没有用空行分句）"
    if metric == "分句均字":
        return next((x for x in (m[0] for m in _CLAUSES.finditer(text)) if 2 <= len(_LETTERS.findall(x)) <= 4), "").strip(BLANKS)[:40]
    return ""


def _evident(through: tuple[str, str] | None):
    rules = {m: (way == "hi", limit) for m, (way, _, limit, _) in (V.STYLE_RULES | V.DIALOGUE_RULES).items()}

    def of(texts: list[str]) -> list[list[dict]]:
        _, checked, talks, style, talk = _of(texts, through)
        values = {**{m: (checked, style[:, STYLE.index(m)]) for m in V.STYLE_RULES}, **{m: (talks, talk[:, i]) for i, m in enumerate(V.DIALOGUE_RULES)}}
        beyond = {m: ok & (v > rules[m][1] if rules[m][0] else v < rules[m][1]) for m, (ok, v) in values.items()}
        out = []
        for i, x in enumerate(texts):
            broken = [m for m in rules if beyond[m][i]]
            if broken:
                x = _tables(through)[0][np.frombuffer(x.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")
                # Beyond the last closing mark there is no quote: nothing is looked for to the end in vain.
                quotes = [q.strip(BLANKS) for q in re.findall(V.QUOTED, x[: max(x.rfind("」"), x.rfind("”")) + 1])]
                paras = list(_paragraphs(x))
            out.append([{"metric": m, "evidence": _piece(m, x, paras, quotes)} for m in broken])
        return out

    def run(texts: pa.Array) -> pa.Array:
        found, held, chars = [], [], 0
        for x in texts:
            held.append(x.as_py() or "")
            chars += len(held[-1])
            if chars >= _CHARS:
                found += of(held)
                held, chars = [], 0
        found += of(held) if held else []
        return pa.array(found, pa.list_(pa.struct([("metric", pa.string()), ("evidence", pa.string())])))

    return run


def evidence(text: Column | str, through: tuple[str, str] | None = None) -> Column:
    """(metric, evidence) of every measure that lies beyond its rule's limit, as the kernel of `measures` gives them."""
    return F.arrow_udf(_evident(through), "array<struct<metric:string,evidence:string>>")(text)


def measures(text: Column | str, through: tuple[str, str] | None = None) -> Column:
    """cjk, checked, dialogue_checked, style (in the order of STYLE), dialogue (of DIALOGUE_RULES): values are null where a text is too short; null of a null text.

    through: letters and what each is taken for, as of `translate(text, *through)`, which is not made.
    """
    return F.arrow_udf(_kernel(through), TYPE)(text)
