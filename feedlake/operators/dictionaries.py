"""Phrase dictionaries as tables: an automaton or a table of keys that is broadcast, and a join of word runs for dictionaries that
are too large for that. None puts the dictionary into the plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from feedlake.functions.text import SLICE_CHARS, key_of, phrase_keys
from feedlake.functions.values import once
from feedlake.operators.kept import kept

try:
    import ahocorasick
except ImportError:  # without it every dictionary is joined, and lists of phrases are one pattern
    ahocorasick = None

#: Characters of all keys together up to which a dictionary becomes an automaton (some hundred bytes each in every worker), and up
#: to which its keys are held by every worker (some twenty bytes each).
AUTOMATON_CHARS, RUNS_CHARS = 100_000, 20_000_000
SCHEMA = "ord long, type string, name string, phrase string, key string, aliases array<string>"
ENTITY = StructType([StructField(c, StringType()) for c in ("type", "canonical_name", "matched_text", "source_field", "confidence")] + [StructField("aliases", ArrayType(StringType()))])
#: A run of letters and digits, or one character between such runs.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def entries_of(entries: list[tuple[str, str, list[str]]]) -> list[tuple]:
    """Rows of SCHEMA from (type, name, aliases): one for each name and alias, in order; phrases without letters or digits fall out."""
    rows = [(kind, name, p, key_of(p), list(aliases)) for kind, name, aliases in entries for p in [name, *aliases] if key_of(p)]
    return [(i, *r) for i, r in enumerate(rows)]


def dictionary_table(spark: SparkSession, entries: list[tuple[str, str, list[str]]]) -> DataFrame:
    """The rows of entries_of as a table, fit to be stored beside others and read instead of a list."""
    return spark.createDataFrame(entries_of(entries), SCHEMA)


def _automaton(keys: list[str]):
    made = ahocorasick.Automaton()
    for key in keys:
        made.add_word(key, key)
    made.make_automaton()
    return made


def whole_phrases(text: str, automaton) -> set[str]:
    """The keys that stand in a key text with neither a letter nor a digit right before or behind them."""
    found, last = set(), len(text) - 1
    for end, key in automaton.iter(text):
        begin = end - len(key)
        if key not in found and (begin < 0 or not text[begin].isalnum()) and (end == last or not text[end + 1].isalnum()):
            found.add(key)
    return found


#: A run of letters and digits, as str.isalnum has them.
_RUN = re.compile(r"[^\W_]+")


def _stands(text: str, key: str) -> bool:
    """Whether a key stands somewhere in a text with neither a letter nor a digit right before or behind it."""
    at = text.find(key)
    while at >= 0:
        end = at + len(key)
        if (at == 0 or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
            return True
        at = text.find(key, at + 1)
    return False


def _stretches(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): the places from begins[i] on, sizes[i] of them, for every i, one after the other, each with its i."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + (begins - (np.cumsum(sizes) - sizes))[which]


class Phrases:
    """whole_phrases of many keys and many texts: a key's letters and digits from the first to the last are a run of words. Runs of as many
    words as keys have are told by hashes of their characters, a slice of texts at a time in numpy, and what has a key's hash is compared
    with it character by character. Keys that begin or end otherwise are looked for where their words are found, those without words
    everywhere."""

    #: Of the hash, a sum of characters times powers of this odd number modulo 2^64.
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.letters = np.zeros(0x110000, bool)  # of every code point whether it is a letter or digit
        for m in _RUN.finditer("".join(map(chr, range(0x110000)))):
            self.letters[m.start():m.end()] = True
        self.powers = self.inverse = np.ones(1, np.uint64)
        cores, found, ragged, worded = [], [], [], np.zeros(len(keys), bool)
        held = 0
        for first, codes, begins, starts, ends, of, sums in self._slices(pa.array(keys, pa.string())):
            mine, n = np.unique(of, return_counts=True)
            last = np.cumsum(n) - 1
            begin, end = starts[last - n + 1], ends[last]
            sizes = np.append(begins[1:], len(codes) + 1) - 1 - begins
            found.append((mine + first, begin + held, end - begin, self._hash(sums, begin, end), n))
            worded[mine + first] = True
            ragged.append(mine[(begin > begins[mine]) | (end < begins[mine] + sizes[mine])] + first)
            cores.append(codes)
            held += len(codes)
        self.codes = np.concatenate([*cores, np.empty(0, np.uint32)])
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64)
        *columns, n_words = (np.concatenate([np.empty(0, kind), *(f[i] for f in found)]) for i, kind in enumerate(kinds))
        self.tables = []  # of each number of words: it, places of the hash that any key has, and number, begin, size and hash of the keys by hash
        for n in np.unique(n_words).tolist():
            mine = np.flatnonzero(n_words == n)
            mine = mine[np.argsort(columns[3][mine], kind="stable")]
            shift = np.uint64(64 - min(26, 6 + len(mine).bit_length()))
            any_key = np.zeros(1 << (64 - int(shift)), bool)
            any_key[columns[3][mine] >> shift] = True
            self.tables.append((n, any_key, shift, *(c[mine] for c in columns)))
        self.ragged = np.zeros(len(keys), bool)
        self.ragged[np.concatenate([*ragged, np.empty(0, np.int64)])] = True
        self.bare = np.flatnonzero(~worded).tolist()

    def _slices(self, texts: pa.Array) -> Iterator[tuple]:
        """Texts in slices of about SLICE_CHARS: number of the first, code points, where each text begins, where each word does and ends and
        of which text it is, and sums for hashes."""
        part = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            own = [t or "" for t in texts.slice(a, b - a).to_pylist()]
            codes = np.frombuffer("\n".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
            begins = np.cumsum([0, *(len(t) + 1 for t in own[:-1])])
            turns = np.flatnonzero(np.diff(self.letters[codes].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            starts, ends = turns[::2], turns[1::2]
            if len(self.powers) <= len(codes):
                row = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), x, np.uint64)]))
                self.powers, self.inverse = row(self.BASE), row(pow(self.BASE, -1, 1 << 64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:len(codes)])])
            yield a, codes, begins, starts, ends, np.searchsorted(begins, starts, "right") - 1, sums

    def _hash(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * self.inverse[begin]

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of a text, number of a key) wherever a text has a key, each once and in order."""
        out = []
        for first, codes, _, starts, ends, of, sums in self._slices(texts):
            for n, any_key, shift, number, key_begin, key_size, key_hash in self.tables:
                begin, end, same = starts[:max(0, len(starts) - n + 1)], ends[n - 1:], of[n - 1:]
                hashes = self._hash(sums, begin, end)
                at = np.flatnonzero(any_key[hashes >> shift])
                at = at[of[at] == same[at]]
                low = np.searchsorted(key_hash, hashes[at])
                hit = np.append(key_hash, np.uint64(0))[low] == hashes[at]
                at, low = at[hit], low[hit]
                which, key = _stretches(low, np.searchsorted(key_hash, hashes[at], "right") - low)
                at = at[which]
                alike = end[at] - begin[at] == key_size[key]
                at, key = at[alike], key[alike]
                which, here = _stretches(begin[at], key_size[key])
                there = _stretches(key_begin[key], key_size[key])[1]
                right = np.bincount(which[codes[here] != self.codes[there]], minlength=len(at)) == 0
                out.append(np.unique((of[at[right]] + first) * len(self.keys) + number[key[right]]))
        if self.bare:
            every = [(i * len(self.keys) + k) for i, text in enumerate(texts.to_pylist()) if text for k in self.bare if _stands(text, self.keys[k])]
            out.append(np.array(every, np.int64))
        text, key = np.divmod(np.unique(np.concatenate([*out, np.empty(0, np.int64)])), max(1, len(self.keys)))
        doubtful = np.flatnonzero(self.ragged[key]).tolist() if self.ragged.any() else []
        if doubtful:
            wrong = [j for j in doubtful if not _stands(texts[int(text[j])].as_py(), self.keys[key[j]])]
            text, key = np.delete(text, wrong), np.delete(key, wrong)
        return text, key


def _by_automaton(keys: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Phrases.found by one automaton."""
    automaton, number = _automaton(keys), {key: i for i, key in enumerate(keys)}

    def found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        every = [(i, k) for i, text in enumerate(x.as_py() for x in texts) if text for k in sorted(number[key] for key in whole_phrases(text, automaton))]
        pairs = np.array(every, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return found


def _in_workers(spark: SparkSession, table: pa.Table, by_automaton: bool, fields: Column, keys: Column) -> Column:
    """Entities of a dictionary that every worker holds. Python finds places in the dictionary alone; what stands there is taken
    from its columns, an Arrow batch at a time."""
    sent = spark.sparkContext.broadcast(table.combine_chunks())

    @F.arrow_udf(ArrayType(ENTITY))
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = sent.value
        coded = own["key"].combine_chunks().dictionary_encode()
        distinct, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows, n_rows = np.argsort(numbers, kind="stable"), np.bincount(numbers, minlength=len(distinct))
        first_row = np.cumsum(n_rows) - n_rows
        orders = own["ord"].to_numpy()
        found = _by_automaton(distinct) if by_automaton and distinct else Phrases(distinct).found
        names = [own[c].combine_chunks() for c in ("type", "name", "phrase", "aliases")]
        for fields, texts in batches:
            of, row_of = fields.flatten(), pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
            at, key = found(texts.flatten())
            which, place = _stretches(first_row[key], n_rows[key])
            at, place = at[which], rows[place]
            order = np.lexsort((place, at, orders[place], row_of[at]))
            at, place = at[order], place[order]
            kind, name, phrase, aliases = (c.take(pa.array(place, pa.int64())) for c in names)
            entities = pa.StructArray.from_arrays([kind, name, phrase, of.take(pa.array(at, pa.int64())), pa.array(["exact"] * len(at), pa.string()), aliases], names=ENTITY.names)
            sizes = np.bincount(row_of[at], minlength=len(texts))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entities)

    return each(fields, keys)


def _by_join(staged: DataFrame, texts: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Every run of as many pieces as a phrase has, joined with the phrases."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    phrases = dictionary.withColumn("__n", F.size(pieces(F.col("key"))))
    lengths = [r[0] for r in phrases.select("__n").distinct().collect()]  # as many as phrases have different lengths
    staged = kept(staged.withColumn("__row", F.monotonically_increasing_id()))
    cut = staged.select("__row", F.posexplode(texts).alias("__at", "t")).select("__row", "__at", F.col("t.source_field").alias("__field"), pieces(F.col("t.key")).alias("p"))
    word = lambda x: x.rlike(r"^[\p{L}\p{N}]")
    clear = lambda beside: beside.isNull() | ~word(beside)  # noqa: E731 (no letter or digit beside a run's end)

    def runs(n: int) -> Column:
        at = lambda i, k: F.get(F.col("p"), i + k)
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size("p") - n, F.lit(0))), lambda i: F.when(clear(F.when(i > 0, at(i, -1))) & clear(at(i, n)), F.concat(*[at(i, k) for k in range(n)])))
        return F.array_compact(every)

    grams = cut.select("__row", "__at", "__field", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("key")) if lengths else cut.select("__row", "__at", "__field", F.lit("").alias("key")).where(F.lit(False))
    entity = F.struct(F.col("type"), F.col("name").alias("canonical_name"), F.col("phrase").alias("matched_text"), F.col("__field").alias("source_field"), F.lit("exact").alias("confidence"), F.col("aliases"))
    hits = grams.join(phrases, "key").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("ord", "__at", entity.alias("e")))).alias("__hits"))
    found = staged.join(hits, "__row", "left")
    return found.withColumn(out, F.coalesce(F.transform("__hits", lambda h: h["e"]), F.array().cast(ArrayType(ENTITY)))).drop("__row", "__hits")


def with_matches(staged: DataFrame, texts: str, dictionary: DataFrame | list[tuple[str, str, list[str]]], out: str, automaton_chars: int = AUTOMATON_CHARS, runs_chars: int = RUNS_CHARS) -> DataFrame:
    """staged with `out`: an entity for each phrase of the dictionary and each text that has it as a whole phrase, in the order of
    the dictionary and then of the texts (an array of structs with source_field and key, the text under normalize_key).

    The dictionary is a list of (type, name, aliases) or a table of SCHEMA, whose keys are under normalize_key. Up to
    automaton_chars of keys it is collected, becomes one Aho-Corasick automaton and is broadcast: a text is read once, however
    many phrases there are, and no row is moved. Up to runs_chars it is broadcast as a table, in which a text's runs of words are
    looked up. Beyond that texts are cut into runs of as many pieces as phrases have and joined with the table; nothing is collected
    but the phrases' different lengths. All give the same rows.

    Null texts and empty dictionaries match nothing; phrases of several entries give each of them.
    """
    spark = staged.sparkSession
    automaton_chars = automaton_chars if ahocorasick is not None else -1
    if isinstance(dictionary, list):
        rows = entries_of(dictionary)
        chars = sum(len(r[4]) for r in rows)
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        table = pa.table({c: pa.array(v, kind) for c, v, kind in zip(("ord", "type", "name", "phrase", "key", "aliases"), columns, (pa.int64(), *[pa.string()] * 4, pa.list_(pa.string())), strict=True)})
        dictionary = spark.createDataFrame(rows, SCHEMA) if chars > max(automaton_chars, runs_chars) else None
    else:
        dictionary = dictionary.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).where("key <> ''")
        chars = dictionary.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
        table = dictionary.toArrow() if chars <= max(automaton_chars, runs_chars) else None
    if chars <= max(automaton_chars, runs_chars):
        # once: an explode of what is found would else have it found twice, the first time to leave out rows without any
        return staged.withColumn(out, once(_in_workers(spark, table, chars <= automaton_chars, F.col(f"{texts}.source_field"), F.col(f"{texts}.key"))))
    return _by_join(staged, texts, dictionary, out)


def with_keys(staged: DataFrame, text: str, phrases: list[str], out: str) -> DataFrame:
    """with_all_keys of one text."""
    return with_all_keys(staged, [(text, phrases, out)])


def with_all_keys(staged: DataFrame, searches: list[tuple[str, list[str], str]]) -> DataFrame:
    """staged with `out` of each search (text, phrases, out): the keys of the phrases that the column `text`, under normalize_key, has as
    whole phrases, each once, in order; a null text has none. One pass over a text, by an automaton of the list, which is a constant of the
    program and small; all searches are one step, so a task has one Python worker for them."""
    keys = [sorted({k for k in map(key_of, phrases) if k}) for _, phrases, _ in searches]
    if ahocorasick is None:
        return staged.withColumns({out: F.coalesce(F.array_sort(phrase_keys(F.col(text), phrases)), F.array().cast("array<string>")) for text, phrases, out in searches})
    sent = staged.sparkSession.sparkContext.broadcast([_automaton(of) for of in keys])
    names = [out for _, _, out in searches]

    @F.arrow_udf(StructType([StructField(name, ArrayType(StringType())) for name in names]))
    def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automata = sent.value
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one text comes without its tuple
            found = [pa.array(([] if t is None else sorted(whole_phrases(t, automaton)) for t in (x.as_py() for x in texts)), pa.list_(pa.string()), size=len(texts)) for texts, automaton in zip(columns, automata, strict=True)]
            yield pa.StructArray.from_arrays(found, names=names)

    hits = staged.withColumn("__hits_of", each(*[F.col(text) for text, _, _ in searches]))
    return hits.withColumns({name: F.col("__hits_of")[name] for name in names}).drop("__hits_of")
