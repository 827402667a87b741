"""Language of texts and of the stretches of mixed ones, by bit-sliced Bloom filters over n-grams.

Every slot of the filter is a bit mask with one bit per language. An n-gram is looked up in ``HASHES`` slots;
the AND of their masks is the set of languages that contain it. For a sentence the masks are popcounted per
language, and the count that is due to false positives is taken off. A shortest-path pass over the
sentences of a text then pays for every change of language, so that sentences without evidence follow
their neighbours; maximal runs are the stretches.

The filter is fitted on the seeds below and on a bounded sample of labelled rows (``per_language`` texts of
each label, picked by hash); labels that the first fit contradicts are dropped for the second. It is about
a quarter of a megabyte at any size of data. Detection is one vectorised pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("zh", "ja", "ko", "en", "fr", "de", "es")
#: ISO 639-1, 639-2/B, 639-2/T and 639-3 codes.
CODES = {
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "ja": "ja", "jpn": "ja", "ko": "ko", "kor": "ko", "en": "en", "eng": "en",
    "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es",
}
MISSING = ("", "und", "unknown")

SEEDS = {
    "zh": "他们在旧城的图书馆里找到了一本没有名字的书。因为下雨，我们只好把行程推迟到明天。这是一个关于朋友与家人的故事，虽然简单，却让人难忘。没有人知道她从哪里来，也没有人问过她要去什么地方。他終於明白，真正重要的東西從來不在遠方。這部作品的畫面與音樂都很出色，但是後半段節奏太慢。",
    "ja": "彼らは古い図書館で名前のない本を見つけた。雨が降ったので、わたしたちは出発を明日に延ばすことにした。これは友だちと家族についての物語であり、とても心に残る。彼女がどこから来たのかを知る人はいない。そして、誰もその話を信じなかった。音楽も映像もすばらしいが、後半は少し長いと感じられる。",
    "ko": "그들은 오래된 도서관에서 이름 없는 책을 찾았다. 비가 와서 우리는 출발을 내일로 미루기로 했다. 이것은 친구와 가족에 대한 이야기이다. 그녀가 어디에서 왔는지 아는 사람은 아무도 없었다. 하지만 그는 끝까지 포기하지 않았고, 다시 길을 떠났다. 음악과 그림은 좋지만 뒷부분이 조금 길다.",
    "en": "They found a book without a name in the old library. Because it was raining, we had to put off the journey until the next day. This is a story about friends and family that nobody will forget. When she opened the door, there was no one in the house. The pictures and the music are good, but the second half is too long. He has never told them where he came from, and she did not ask.",
    "fr": "Ils ont trouvé un livre sans nom dans la vieille bibliothèque. Comme il pleuvait, nous avons dû remettre le voyage au lendemain. C'est une histoire d'amis et de famille que personne n'oubliera. Quand elle a ouvert la porte, il n'y avait plus personne dans la maison. Les images et la musique sont belles, mais la fin est trop longue. Il ne leur a jamais dit d'où il venait, et elle n'a pas demandé.",
    "de": "Sie fanden in der alten Bibliothek ein Buch ohne Namen. Weil es regnete, mussten wir die Reise auf den nächsten Tag verschieben. Das ist eine Geschichte über Freunde und Familie, die niemand vergessen wird. Als sie die Tür öffnete, war niemand mehr im Haus. Die Bilder und die Musik sind schön, aber das Ende ist zu lang. Er hat ihnen nie gesagt, woher er kam, und sie haben nicht gefragt.",
    "es": "Encontraron un libro sin nombre en la vieja biblioteca. Como llovía, tuvimos que dejar el viaje para el día siguiente. Esta es una historia de amigos y familia que nadie olvidará. Cuando ella abrió la puerta, ya no había nadie en la casa. Las imágenes y la música son buenas, pero el final es demasiado largo. Él nunca les dijo de dónde venía, y ella no se lo preguntó.",
}

SENTENCE = re.compile(r"[^\n\r。！？!?…．]*?(?:[。！？!?…．]+[\"'”’」』】）)\]》〉]*|\.[\"'”’」』】）)\]》〉]*(?=\s|[぀-ヿ㐀-鿿가-힯])|[\n\r]+|$)")
NAME_MARK = re.compile(r"[A-Za-z][!?]+$")
QUOTED = re.compile(r"《[^》]*》|『[^』]*』|「[^」]*」|〈[^〉]*〉|【[^】]*】|\([^)]*\)|（[^）]*）|\"[^\"]*\"|“[^”]*”")

SLOTS, HASHES = 1 << 18, 3
CJK_WEIGHT, SWITCH, CAP = 3.0, 12.0, 90.0  #: weight of a CJK n-gram, cost of a change, most evidence of a sentence


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 65 536: lower case of one width, and class (0 none, 1 alphabet, 2 CJK)."""
    low, kind = np.arange(65536, dtype=np.uint32), np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if 0xFF01 <= c <= 0xFF5E:
            low[c] = ord(chr(c - 0xFEE0).lower())
            kind[c] = 1 if chr(c - 0xFEE0).isalpha() else 0
        elif 0x3041 <= c <= 0x30FA or c == 0x30FC or 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0xF900 <= c <= 0xFAFF or 0xFF66 <= c <= 0xFF9F or 0x1100 <= c <= 0x11FF:
            kind[c] = 2
        elif unicodedata.category(ch)[0] in "LM" and c < 0x2E80:
            kind[c] = 1
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    return low, kind


LOW, KIND = _tables()
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(codes: np.ndarray, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, weight) of the n-grams of a text: one and two CJK characters, three of an alphabet with word ends."""
    bmp = np.minimum(codes, 65535)
    low, kind = np.where(codes < 65536, LOW[bmp], codes).astype(np.uint64), np.where(codes < 65536, KIND[bmp], np.where(codes >= 0x20000, 2, 0))
    if hidden is not None:
        kind = np.where(hidden, 0, kind)
    low = np.where(kind == 0, np.uint64(32), low)
    a = low * np.uint64(0x100000001B3)
    uni = np.flatnonzero(kind == 2)
    bi = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2))
    tri = np.flatnonzero((kind[:-2] < 2) & (kind[1:-1] == 1) & (kind[2:] < 2))
    with np.errstate(over="ignore"):
        h = np.concatenate([a[uni] ^ np.uint64(1 << 62), (a[bi] * np.uint64(31)) ^ (low[bi + 1] << np.uint64(24)) ^ np.uint64(2 << 61), (a[tri] * np.uint64(31) + low[tri + 1]) * np.uint64(1000003) + low[tri + 2]])
    return h, np.concatenate([uni, bi, tri + 1]), np.concatenate([np.full(len(uni) + len(bi), CJK_WEIGHT, np.float32), np.ones(len(tri), np.float32)])


def _slots(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h[:, None] * MIX[None, :HASHES]
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(13)).astype(np.int64) % SLOTS


BIT = ((np.arange(1 << len(LANGS))[:, None] >> np.arange(len(LANGS))) & 1).astype(np.float64)  #: bits of every mask


@dataclass(frozen=True)
class Filter:
    masks: np.ndarray  #: of every slot: bit l is set if language l may contain the n-gram
    chance: np.ndarray  #: false-positive rate per language

    def mask(self, h: np.ndarray) -> np.ndarray:
        """Of every n-gram the bit mask of the languages that may contain it."""
        s = _slots(h)
        out = self.masks[s[:, 0]]
        for j in range(1, HASHES):
            out = out & self.masks[s[:, j]]
        return out

    def found(self, h: np.ndarray) -> np.ndarray:
        """n-grams x languages: which languages contain each."""
        return BIT[self.mask(h)].astype(np.uint8)


def _fit(texts: list[tuple[str, str]]) -> Filter:
    df: list[dict[int, int]] = [{} for _ in LANGS]
    count = [0] * len(LANGS)
    for lang, text in texts:
        i = LANGS.index(lang)
        count[i] += 1
        for h in np.unique(grams(_codes(text))[0]).tolist():
            df[i][h] = df[i].get(h, 0) + 1
    rate: dict[int, list[float]] = {}
    for i, one in enumerate(df):
        for h, n in one.items():
            if n >= 2 or count[i] < 40:
                rate.setdefault(h, [0.0] * len(LANGS))[i] = n / (count[i] + 1)
    masks = np.zeros(SLOTS, np.uint8)
    if rate:
        hs, rates = np.fromiter(rate, np.uint64, len(rate)), np.array(list(rate.values()))
        member = (rates >= 0.25 * rates.max(1, keepdims=True)) & (rates > 0)
        slots = _slots(hs)
        for i in range(len(LANGS)):
            masks[slots[member[:, i]].ravel()] |= np.uint8(1 << i)
    fill = ((masks[:, None] >> np.arange(len(LANGS), dtype=np.uint8)) & 1).mean(0)
    return Filter(masks, fill**HASHES)


def fit(labelled: list[tuple[str, str]]) -> Filter:
    """The filter from (language, text) pairs, whose labels may be wrong in part, and the seeds."""
    seeds = [(lang, s) for lang, text in SEEDS.items() for s in re.findall(r"[^。.]+[。.]", text)] * 3
    first = _fit(seeds + labelled)
    sure = [(lang, text) for lang, text in labelled if {s[2] for s in stretches(text, first)} == {lang}]
    return _fit(seeds + sure)


def stretches(text: str, model: Filter) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the maximal stretches of ``text``; none if it has no letters."""
    spans: list[tuple[int, int]] = []
    for m in SENTENCE.finditer(text):
        if m.end() == m.start():
            continue
        if spans and text[m.end() - 1] in "。」』" and NAME_MARK.search(text, *spans[-1]):  # the mark stood in a name
            spans[-1] = (spans[-1][0], m.end())
        else:
            spans.append((m.start(), m.end()))
    if not spans:
        return []
    codes = _codes(text)
    hidden = None
    if QUOTED.search(text):
        hidden = np.zeros(len(codes), bool)
        letters = KIND[np.minimum(codes, 65535)] > 0
        for a, b in spans:
            inner = hidden[a:b]
            for m in QUOTED.finditer(text, a, b):
                inner[m.start() - a : m.end() - a] = True
            if (letters[a:b] & ~inner).sum() < 6:
                inner[:] = False
    h, pos, weight = grams(codes, hidden)
    if not len(h):
        return []
    at = np.searchsorted(np.array([a for a, _ in spans]), pos, side="right") - 1
    size = len(BIT)
    seen = np.bincount(at * size + model.mask(h), weight, len(spans) * size).reshape(-1, size)  # weight of every mask in every sentence
    total, got = seen.sum(1), seen @ BIT  # popcounts per language
    share = np.clip((got - total[:, None] * model.chance) / np.maximum(total[:, None] * (1 - model.chance), 1e-9), 0, 1)
    gain = share * np.minimum(total, CAP)[:, None]
    best, back = gain[0].copy(), []
    for row in gain[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(LANGS)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    lang = [int(best.argmax())]
    for row in reversed(back):
        lang.append(int(row[lang[-1]]))
    lang.reverse()
    out: list[tuple[int, int, str, float]] = []
    lo = 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or lang[i] != lang[lo]:
            sums, weights = gain[lo:i].sum(0), max(1e-9, np.minimum(total[lo:i], CAP).sum())
            others = np.delete(sums, lang[lo]).max()
            sure = float(1 / (1 + np.exp(-(sums[lang[lo]] - others) / np.sqrt(weights) * 1.5))) if total[lo:i].sum() else 0.5
            out.append((spans[lo][0], spans[i - 1][1], LANGS[lang[lo]], round(sure, 6)))
            lo = i
    return out


def label_language(label: Column) -> Column:
    """The language that a label names: null if it is missing, ``?`` if it is no known code."""
    code = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]*)", 1))
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(label.isNull() | F.lower(F.trim(label)).isin(*MISSING), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, code), F.lit("?")))


def fit_on(df: DataFrame, text: str, label: str, per_language: int = 300, most_chars: int = 2000) -> Filter:
    """The filter fitted on at most ``per_language`` labelled texts of each language, of which ``most_chars`` characters each are read; repeated rows count once."""
    named = df.select(label_language(F.col(label)).alias("lang"), F.substring(F.col(text), 1, most_chars).alias("text")).where(F.col("lang").isin(*LANGS) & (F.length("text") > 20))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = named.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= per_language).select("lang", "text").distinct().collect()  # bounded: 7 x per_language
    return fit(sorted((r["lang"], r["text"]) for r in rows))


def language_stretches(df: DataFrame, keys: list[str], text: str, model: Filter) -> DataFrame:
    """(keys, seg_no, n_seg, start, end, lang, confidence) for every stretch of every text of ``df``.

    Null texts and texts without letters give nothing. Repeated rows give repeated stretches; only the
    columns named are read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    types = [df.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, types)) + ", seg_no long, n_seg long, start int, end int, lang string, confidence double"
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, of, start, end, lang, sure = [], [], [], [], [], [], []
            for i, t in enumerate(b.column(n).to_pylist()):
                got = stretches(t, shared.value) if t else []
                row += [i] * len(got)
                no += range(1, len(got) + 1)
                of += [len(got)] * len(got)
                start += [g[0] for g in got]
                end += [g[1] for g in got]
                lang += [g[2] for g in got]
                sure += [g[3] for g in got]
            take = pa.array(row, pa.int64())
            cols = [b.column(j).take(take) for j in range(n)]
            cols += [pa.array(no, pa.int64()), pa.array(of, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "seg_no", "n_seg", "start", "end", "lang", "confidence"])

    return df.select(*keys, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
