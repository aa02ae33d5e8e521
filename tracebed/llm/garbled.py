"""Text decoded in a wrong encoding: found and restored by noisy-channel decoding.

What a reader did wrong is a pair: the encoding the bytes were read in, and the one they were written in. Each
distinct odd piece of the corpus is turned back into bytes under every reader, lost bytes staying open, and read
again under every writer; the readings are held against the corpus' own word frequencies. A Viterbi search over each
document's pieces then chooses between "as it stands" and one pair for a whole passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebed.session import Scratch

#: log-odds a passage must gather before it counts as damaged: a rare event, and one of many pairs
ENTER = 9.0
#: cost of going on to another pair, and of a piece inside a passage that the pair doesn't explain
SWITCH, SKIP = 6.0, 1.5
#: count that a word no document holds is given; each further letter makes it e times less likely
UNSEEN = 0.02
#: log-odds for each character beyond ASCII that well-formed UTF-8 yields
UTF8_GAIN = 1.5
#: readings of a piece worth keeping for the search
KEEP_GAIN = 1.0
#: different pieces that one task reads in all ways
READ_ROWS = 2000
#: ways the search inside a piece keeps to each byte where lost bytes leave several
LIST = 128

# fixed values: encodings texts are written in and read in by mistake
READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "iso8859_5", "iso8859_7", "iso8859_9", "cp1256", "cp1258", "cp858", "mac_latin2", "gb18030", "big5", "cp932", "cp949")
LEGACY_READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
LEGACY_WRITERS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "mac_cyrillic", "cp932", "euc_jp", "gb18030", "big5", "euc_kr")
LOST = "�"

#: a piece: a run of characters that aren't ASCII blanks, digits or punctuation, with one beyond ASCII at least
#: (possessive and only from where a run begins, so that long ASCII runs cost their length once)
PIECE = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F][^\x00-\x40\x5B-\x60\x7B-\x7F]*+"
#: a word of the frequency table: a run of letters and marks, or any other single character beyond ASCII
WORD = r"\p{L}[\p{L}\p{M}]*|[^\x00-\x7F]"


@lru_cache(maxsize=64)
def _to_byte(encoding: str) -> dict[str, bytes]:
    """Characters of an encoding and their bytes; bytes it leaves open stand for the control character of that number, as readers do."""
    table = {}
    if encoding in ("gb18030", "big5", "cp932", "cp949", "euc_jp", "euc_kr"):
        return table
    for i in range(256):
        byte = bytes([i])
        try:
            table[byte.decode(encoding)] = byte
        except UnicodeDecodeError:
            table.setdefault(chr(i), byte)
    if encoding == "cp1252":
        for i in range(128, 160):
            table.setdefault(chr(i), bytes([i]))
    return table


@lru_cache(maxsize=64)
def _open_bytes(encoding: str) -> frozenset[int]:
    """The bytes that are lost when read in this encoding: those it leaves open; of encodings with several bytes a character any high one may be."""
    if not _to_byte(encoding):
        return frozenset(range(0x80, 0x100))
    lost = set()
    for i in range(0x80, 0x100):
        try:
            bytes([i]).decode(encoding)
        except UnicodeDecodeError:
            lost.add(i)
    return frozenset(lost)


def _bytes_of(piece: str, reader: str) -> list[int | None] | None:
    """The bytes that the reader took for this piece, None for each lost one; None if it can't have been read so."""
    table = _to_byte(reader)
    if LOST in piece and not _open_bytes(reader):
        return None
    out: list[int | None] = []
    try:
        for i, part in enumerate(piece.split(LOST)):
            out += [None] * (i > 0)
            out += b"".join(table[c] for c in part) if table else part.encode(reader)
    except (KeyError, UnicodeEncodeError):
        return None
    return out


@lru_cache(maxsize=1 << 16)
def _follows(before: str, c: str) -> bool:
    """Whether a character that fills lost bytes may stand behind another: of one script, and no capital behind a small letter."""
    return not (before.islower() and c.isupper()) and _plausible(before + c)


class Alphabet:
    """Characters of the corpus with their counts, by which open bytes of UTF-8 are filled."""

    def __init__(self, counts: dict[str, float]):
        self.weight = {c: math.log(n) for c, n in counts.items()}
        self.by_length: dict[int, list[tuple[bytes, str]]] = {}
        for c in counts:
            data = c.encode("utf-8", "surrogatepass")
            self.by_length.setdefault(len(data), []).append((data, c))
        self.known: dict[tuple, list[tuple[float, str]]] = {}

    def edges(self, pattern: tuple[int | None, ...], lost: frozenset[int]) -> list[tuple[float, str]]:
        """(weight, character) of all characters whose bytes these are, lost ones left open."""
        if None not in pattern:
            try:
                c = bytes(pattern).decode("utf-8")
            except UnicodeDecodeError:
                return []
            return [(self.weight.get(c, -1.0), c)] if len(c) == 1 else []
        key = (pattern, lost)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            fits = lambda data: all(b == p if p is not None else b in lost for b, p in zip(data, pattern))
            self.known[key] = [(self.weight[c], c) for data, c in self.by_length.get(len(pattern), []) if fits(data)]
        return self.known[key]

    def readings(self, data: list[int | None], lost: frozenset[int]) -> list[str]:
        """The best readings of a byte lattice as UTF-8: Viterbi from byte to byte, keeping the LIST likeliest ways to each place.

        Without lost bytes there is one way at most. A character of which no byte is left is no edge here: words of
        such characters are found by their shape.
        """
        ways: list[list[tuple[float, str]]] = [[] for _ in range(len(data) + 1)]
        ways[0] = [(0.0, "")]
        if None not in data:
            try:
                return [bytes(data).decode("utf-8")]
            except UnicodeDecodeError:
                return []
        for i in range(len(data)):
            here = ways[i] if len(ways[i]) <= LIST else sorted(ways[i], reverse=True)[:LIST]
            first = data[i]
            lengths = range(2, 5) if first is None else (1,) if first < 0x80 else (2,) if 0xC2 <= first < 0xE0 else (3,) if 0xE0 <= first < 0xF0 else (4,) if 0xF0 <= first < 0xF5 else ()
            for n in lengths if here else ():
                if i + n <= len(data):
                    pattern = tuple(data[i : i + n])
                    if all(b is None for b in pattern):
                        continue
                    for w, c in self.edges(pattern, lost):
                        ways[i + n] += [(v + w, t + c) for v, t in here if None not in pattern or _follows(t[-1:], c)]
        return [t for _, t in sorted(ways[-1], reverse=True)[:LIST]]


@lru_cache(maxsize=1)
def _any_alphabet() -> Alphabet:
    return Alphabet({chr(c): 1.0 for c in range(0x80, 0x3000)})


def _plausible(text: str) -> bool:
    """Whether a reading looks like text at all: no controls, no letters of two scripts in one word, no capital after a small letter."""
    import regex

    if regex.search(r"[\p{Cc}\p{Cn}\p{Co}\p{Cs}\x80-\x9f]|�", text):
        return False
    if regex.search(r"[\p{Latin}][\p{Cyrillic}\p{Greek}\p{Han}\p{Hangul}]|[\p{Cyrillic}\p{Greek}][\p{Latin}]|\p{Cyrillic}\p{Greek}|\p{Greek}\p{Cyrillic}|\p{Ll}\p{Lu}\p{Ll}", text):
        return False
    return not regex.search(r"\p{L}[\p{Sm}\p{So}\p{Sc}¡-¿]+\p{L}", text)


def _sound(text: str) -> bool:
    """Whether a piece holds assigned characters only, no controls."""
    import regex

    return not regex.search(r"[\p{Cc}\p{Cn}\p{Co}]", text)


def _lettered(text: str) -> bool:
    """Whether the characters beyond ASCII are letters in the main: signs for other signs (frames, dashes) prove nothing."""
    beyond = [c for c in text if ord(c) > 127]
    return 3 * sum(c.isalpha() for c in beyond) >= 2 * len(beyond)


def _utf8_readings(piece: str, alphabet: Alphabet, depth: int = 2) -> dict[str, str]:
    """Readings as UTF-8 text misread once, or twice (each level through one reader): reading -> pair. Lost bytes stay open."""
    out: dict[str, str] = {}
    for reader in READERS:
        data = _bytes_of(piece, reader)
        if data is None:
            continue
        for read in alphabet.readings(data, _open_bytes(reader)):
            if read == piece:
                continue
            out.setdefault(read, f"{reader}>utf-8")
            if depth > 1 and None not in data and any(ord(c) > 127 for c in read):
                for again, pair in _utf8_readings(read, alphabet, depth - 1).items():
                    out.setdefault(again, f"{reader}>utf-8 {pair}")
    return out


def readings(piece: str, alphabet: Alphabet | None = None) -> list[tuple[str, str]]:
    """(pair, reading) of everything a piece may have been, each reading once."""
    found = {r: p for r, p in _utf8_readings(piece, alphabet or _any_alphabet()).items() if _plausible(r)}
    if LOST not in piece:
        odd = not _sound(piece)
        for reader in LEGACY_READERS:
            data = _bytes_of(piece, reader)
            if data is None:
                continue
            for writer in LEGACY_WRITERS:
                if writer == reader or (reader, writer) == ("latin-1", "cp1252") and not odd:
                    continue
                try:
                    read = bytes(data).decode(writer)
                except UnicodeDecodeError:
                    continue
                if read != piece and read not in found and (odd or _lettered(read)) and _plausible(read):
                    found[read] = f"{reader}>{writer}"
    return [(p, r) for r, p in found.items()]


def _words(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def lost_shape(col: Column) -> Column:
    """A text as it stands after every byte beyond ASCII was lost: each character by as many marks as it has bytes in UTF-8."""
    one = F.regexp_replace(col, r"[\x{10000}-\x{10FFFF}]", LOST * 4)
    one = F.regexp_replace(one, r"[\x{0800}-\x{FFFC}]", LOST * 3)
    return F.regexp_replace(one, r"[\x{0080}-\x{07FF}]", LOST * 2)


def pieces_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, piece: the odd pieces of every document, in order."""
    found = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(found).alias("pos", "piece"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n, m: documents and different texts each word occurs in, over all documents and whole texts."""
    texts = docs.where("text is not null").groupBy(F.sha2("text", 256).alias("name")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    return texts.select(F.explode(words).alias("word"), "copies").groupBy("word").agg(F.sum("copies").alias("n"), F.count("*").alias("m"))


def corpus_alphabet(counts: DataFrame) -> dict[str, float]:
    """Characters beyond ASCII of the corpus' words with their counts, capitals as a twentieth of small letters.

    There are no more than Unicode has, which bounds what the driver sees.
    """
    chars = counts.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "m").where(F.col("c").rlike(r"^[^\x00-\x7F]$") & (F.col("c") != LOST))
    small = {r["c"]: float(r["n"]) for r in chars.groupBy("c").agg(F.sum("m").alias("n")).collect()}
    return {c.upper(): n / 20 for c, n in small.items() if len(c.upper()) == 1 and c.upper() != c} | small


def _with_readings(pieces: DataFrame, characters: dict[str, float]) -> DataFrame:
    """piece, pair, reading, words; the piece itself comes with an empty pair."""
    shared = pieces.sparkSession.sparkContext.broadcast(characters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet(shared.value)
        for batch in batches:
            rows = [(p, pair, r, _words(r)) for p in batch.column(0).to_pylist() for pair, r in [("", p), *readings(p, alphabet)]]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["piece", "pair", "reading", "words"])

    return pieces.mapInArrow(read, "piece string, pair string, reading string, words array<string>")


def odd_pieces(pieces: DataFrame, counts: DataFrame, n_docs: int, n_texts: int, scratch: Scratch) -> DataFrame:
    """piece, options (pair, gain, reading): pieces that read better some other way, by the corpus' word frequencies.

    The log-probability of a reading is the sum over its words; gain is what it wins over the piece as it stands.
    Against a reading that forms UTF-8 the piece as it stands has one voice for each different text at most: a damaged text
    would else vote for its own garbage with every copy.
    """
    odds = lambda c, of: F.sum(F.when(F.col(c).isNull(), F.log(F.lit(UNSEEN / of)) - F.length("word") + 1).otherwise(F.log(F.col(c) / of)))
    # few rows, each with much work: spread by number of rows, not by bytes
    distinct = scratch.keep(pieces.select("piece").distinct(), "distinct")
    read = _with_readings(distinct.repartition(max(1, -(-distinct.count() // READ_ROWS))), corpus_alphabet(counts))
    scored = scratch.keep(
        read.select("piece", "pair", "reading", F.explode_outer("words").alias("word"))
        .join(counts, "word", "left")
        .groupBy("piece", "pair", "reading")
        .agg(odds("n", n_docs).alias("p"), odds("m", n_texts).alias("q"), F.count_if(F.col("n").isNull() & F.col("word").isNotNull()).alias("unseen")),
        "scored",
    )
    own = scored.where("pair = ''").select("piece", F.col("p").alias("own"), F.least("p", "q").alias("own_once"))
    gain = F.col("p") - F.col("own")
    # that bytes form UTF-8 at all is evidence by itself, for every character they form
    formed = F.length(F.regexp_replace("reading", r"[\x00-\x7F]", ""))
    gain = F.when(F.endswith("pair", F.lit(">utf-8")), F.col("p") - F.col("own_once") + UTF8_GAIN * formed).otherwise(gain)
    # a single sign for another says little, whatever it would win
    gain = F.when(F.length("piece") < 2, F.least(gain, F.lit(3.0))).otherwise(gain)
    # a reading between two single-byte encodings, or of lost bytes, always exists: only one made of words the corpus holds says anything
    options = scored.where((F.col("pair") != "") & ((F.col("unseen") == 0) | F.endswith("pair", F.lit(">utf-8")) & ~F.contains("piece", F.lit(LOST)))).join(own, "piece").select("piece", F.struct("pair", gain.alias("gain"), "reading").alias("o")).where(F.col("o.gain") > KEEP_GAIN)
    return options.groupBy("piece").agg(F.array_sort(F.collect_list("o")).alias("options"))


def best_path(places: list[dict]) -> tuple[float, dict[int, str]]:
    """Viterbi over one document's odd pieces: (log-odds won, position -> reading), empty when all stands as it is.

    ``places`` have pos (number among all pieces of the document) and options; pieces between them have none.
    """
    states: dict[str, tuple[float, dict | None]] = {"": (0.0, None)}  # pair -> (score, chain of readings)
    last = -1
    for place in places:
        gap = place["pos"] - last - 1
        last = place["pos"]
        if gap:  # pieces without options: free as they stand, a cost inside a damaged passage
            states = {s: (v - SKIP * gap if s else v, c) for s, (v, c) in states.items()}
        top, top_chain = max(states.values(), key=lambda x: x[0])
        clean = max(states[""], (top, top_chain), key=lambda x: x[0])
        new = {"": clean}
        for o in place["options"]:
            pair = o["pair"]
            before = max(
                [(states[pair][0], states[pair][1])] if pair in states else [(-math.inf, None)],
                key=lambda x: x[0],
            )
            enter = (states[""][0] - ENTER, states[""][1])
            other = (top - SWITCH - (ENTER - SWITCH if top_chain is states[""][1] else 0), top_chain)
            score, chain = max(before, enter, other, key=lambda x: x[0])
            value = (score + o["gain"], (place["pos"], o["reading"], chain))
            if pair not in new or value[0] > new[pair][0]:
                new[pair] = value
        for s, (v, c) in states.items():
            if s and s not in new:
                new[s] = (v - SKIP, c)
        states = new
    score, chain = max(states.values(), key=lambda x: x[0])
    found = {}
    while chain is not None:
        found[chain[0]] = chain[1]
        chain = chain[2]
    return score, found


def damaged_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, changes (pos, piece, reading; reading null where it can't be had) of each document with a damaged passage, one for each piece.

    A document that holds U+FFFD has lost bytes and counts as damaged; pieces that the search leaves as they are get the
    corpus' likeliest word of their shape. Null and empty texts are never damaged; repeated rows count once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "garbled")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    pieces = scratch.keep(pieces_of(docs).distinct(), "pieces")
    counts = scratch.keep(word_counts(docs), "counts")
    n_docs, n_texts = docs.agg(F.count("*"), F.count_distinct(F.sha2("text", 256))).first()
    odd = odd_pieces(pieces, counts, max(n_docs, 1), max(n_texts, 1), scratch)
    places = pieces.join(odd, "piece").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "options"))).alias("places"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = pa.struct([("pos", pa.int32()), ("piece", pa.string()), ("reading", pa.string())])
        for batch in batches:
            ids, changes = [], []
            for doc, spots in zip(*(c.to_pylist() for c in batch.columns)):
                _, found = best_path(spots)
                if found:
                    ids.append(doc)
                    changes.append([{"pos": s["pos"], "piece": s["piece"], "reading": found[s["pos"]]} for s in spots if s["pos"] in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(changes, pa.list_(change))], names=["doc_id", "changes"])

    kind = "array<struct<pos: int, piece: string, reading: string>>"
    read = scratch.keep(places.select(F.col("doc_id").cast("long").alias("doc_id"), "places").mapInArrow(search, f"doc_id bigint, changes {kind}"), "read")
    changes = read.select("doc_id", F.explode("changes").alias("c")).select("doc_id", "c.pos", "c.piece", "c.reading")

    # lost bytes: the likeliest word of the shape that is left
    shapes = counts.where(F.col("word").rlike(r"[^\x00-\x7F]") & ~F.col("word").contains(LOST)).select(lost_shape(F.col("word")).alias("shape"), "word", "n")
    likely = shapes.groupBy("shape").agg(F.max(F.struct("n", "word"))["word"].alias("word"))
    lost = pieces.where(F.col("piece").contains(LOST))
    # the table holds small letters: a capital that was not lost stays
    spelt = F.when(F.col("piece").rlike("^[A-Z]"), F.concat(F.substring("piece", 1, 1), F.substr("word", F.lit(2)))).otherwise(F.col("word"))
    holes = lost.join(likely, F.lower("piece") == F.col("shape"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "piece", spelt.alias("reading"))
    both = changes.unionByName(holes.join(changes.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti"))
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "reading"))).alias("changes"))


def restored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, restored, n_open, n_guessed: the texts of damaged documents with every passage restored that can be.

    n_open counts the pieces whose bytes are lost in part, so that nothing can prove what stood there; n_guessed those of
    them for which the likeliest reading has been put in, the others stand as they were.
    """
    scratch = Scratch(docs.sparkSession, "garbled")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    damaged = damaged_documents(docs, scratch)
    known = F.filter("changes", lambda c: c["reading"].isNotNull())
    both = docs.join(damaged, "doc_id").select("doc_id", "text", F.map_from_entries(F.array_distinct(F.transform(known, lambda c: F.struct(c["pos"], c["reading"])))).alias("new"), F.filter("changes", lambda c: F.contains(c["piece"], F.lit(LOST))).alias("lost"))
    # the text between pieces, the pieces and their readings zipped back together
    gaps = F.split("text", PIECE, -1)
    old = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    pieces = F.transform(old, lambda p, i: F.coalesce(F.try_element_at("new", i), p))
    woven = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(pieces, i), F.lit(""))))
    return both.select("doc_id", F.array_join(woven, "").alias("restored"), F.size("lost").alias("n_open"), F.size(F.filter("lost", lambda c: c["reading"].isNotNull())).alias("n_guessed"))
