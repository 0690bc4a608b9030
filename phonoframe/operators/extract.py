"""Tables and links out of crawled pages: one Python stage walks the tags, all else is DataFrame work on cells.

A page's cells are rows (page_id, table_idx, row_idx, col_idx, tag, text, href).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

# Characters that show a phonetic transcription, and what headers say.
IPA_CLASS = r"[\x{190}-\x{1FF}\x{250}-\x{2FF}\x{300}-\x{36F}\x{1D00}-\x{1DBF}\x{2070}-\x{209F}]"
ENTRY_HEADERS = ["entry", "#", "no.", "no"]
RECORDING_TYPES = "word-list|sentence|story|conversation|narrative"
#: Pages go to Python in pieces of so many characters, as Spark's batches are of a number of rows, whatever these weigh.
PIECE = 1024
#: A task holds so many rows of pieces as strings at once, and about so many characters of what it found.
PIECES_AT_ONCE, FOUND_AT_ONCE = 1000, 1 << 20


class _Walk(HTMLParser):
    """Cells of all tables and links, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.links: list[list] = []
        self.tables, self.open = -1, []  # open: [table, row, column, open cell or None]
        self.link, self.error = None, None

    def parse_marked_section(self, i, report=1):
        """As in browsers, <![ other than CDATA begins a comment up to the next >."""
        return super().parse_marked_section(i, report) if self.rawdata.startswith("<![CDATA[", i) else self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "table":
            self.tables += 1
            self.open.append([self.tables, -1, -1, None])
        elif tag == "tr" and self.open:
            self.open[-1][1:] = [self.open[-1][1] + 1, -1, None]
        elif tag in ("td", "th") and self.open and self.open[-1][1] >= 0:
            at = self.open[-1]
            at[2] += 1
            at[3] = [*at[:3], tag, [], None]
            self.cells.append(at[3])
        elif tag == "a" and href is not None:
            self.link = [len(self.links), href, []]
            self.links.append(self.link)
            for at in self.open:
                if at[3] is not None and at[3][5] is None:
                    at[3][5] = href

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.open[-1][3] = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if data := data.strip():
            for at in self.open:
                if at[3] is not None:
                    at[3][4].append(data)
            if self.link is not None:
                self.link[2].append(data)


def _walked(html: str | None) -> _Walk:
    """What can be parsed; ``error`` says why parsing ended early, if it did."""
    w = _Walk()
    try:
        w.feed(html or "")
        w.close()
    except (AssertionError, ValueError, RecursionError) as e:
        w.error = f"{type(e).__name__}: {e}"
    return w


def _pieces(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _pos, _piece): the pieces of each page, one after the other; pages without a character have none."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_pos", "_piece"))


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """The key and markup of each page; one page is held at a time."""
    key, held = None, []
    for batch in parts:
        for start in range(0, batch.num_rows, PIECES_AT_ONCE):
            for k, pos, piece in zip(*[c.to_pylist() for c in batch.slice(start, PIECES_AT_ONCE).columns], strict=True):
                if pos == 0 and held:
                    yield key, "".join(held)
                    held = []
                key = k
                held.append(piece)
    if held:
        yield key, "".join(held)


def _found(pages: DataFrame, key: str, html: str, columns: str, found: Callable[[_Walk], list[tuple]]) -> DataFrame:
    """(key, ``columns``): what ``found`` takes from the walk over each page."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {columns}"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for k, markup in _whole(parts):
            for row in found(_walked(markup)):
                rows.append((k, *row))
                held += 64 + sum(len(x) for x in row if isinstance(x, str))
                if held > FOUND_AT_ONCE:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return _pieces(pages, key, html).mapInArrow(walk, schema)


def markup_errors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, error) of the pages whose markup ends the parser early; what comes before that is in ``cells`` and ``links``."""
    return _found(pages, key, html, "error string", lambda w: [(w.error,)] if w.error else [])


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_idx, row_idx, col_idx, tag, text, href); a page without tables has no row."""
    return _found(pages, key, html, "table_idx int, row_idx int, col_idx int, tag string, text string, href string", lambda w: [(*c[:4], "".join(c[4]), c[5]) for c in w.cells])


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, text) of every link in document order."""
    return _found(pages, key, html, "pos int, href string, text string", lambda w: [(c[0], c[1], "".join(c[2])) for c in w.links])


def language_index(found: DataFrame, base: str, key: str = "page_id") -> DataFrame:
    """(code, name, url): the first link of each language on an index page; a first link without text loses the language."""
    path = r"(?i)^\.\./Language/([^/]+)/([^/]+\.html?)"
    rows = found.select(key, "pos", F.trim("text").alias("name"), F.upper(F.regexp_extract("href", path, 1)).alias("code"), F.regexp_extract("href", path, 2).alias("_file"))
    first = rows.filter("code <> ''").groupBy("code").agg(F.min_by(F.struct("name", "_file"), F.struct(key, "pos")).alias("x"))
    return first.filter("x.name <> ''").select("code", "x.name", F.concat(F.lit(base.rstrip("/") + "/Language/"), "code", F.lit("/"), "x._file").alias("url"))


def table_summary(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_idx, n_rows, headers array, first_rows array of arrays) of each table; first_rows are rows 1 and 2."""
    line = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("row_idx") == i, F.struct("col_idx", "text")))), lambda h: h["text"])
    return rows.groupBy(key, "table_idx").agg((F.max("row_idx") + 1).alias("n_rows"), line(0).alias("headers"), F.filter(F.array(line(1), line(2)), lambda r: F.size(r) > 0).alias("first_rows"))


def recordings_table(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_idx): the first table that speaks of wav and of words, audio or entries; else the one with most rows."""
    low = F.lower("text")
    has = lambda w: F.max(low.contains(w).cast("int"))
    t = rows.groupBy(key, "table_idx").agg(F.max("row_idx").alias("last"), ((has("wav") == 1) & ((has("word") == 1) | (has("audio") == 1) | (has("entries") == 1))).alias("fits"))
    order = F.struct((~F.col("fits")).alias("a"), F.when(F.col("fits"), F.lit(0)).otherwise(-F.col("last")).alias("b"), "table_idx")
    return t.groupBy(key).agg(F.min_by("table_idx", order).alias("table_idx"))


def resolved(page: Column, href: Column) -> Column:
    """The address of a link seen from a page, by RFC 3986 and as browsers read it: a scheme that is the page's own is no scheme.

    Dot segments are taken back by a stack that is folded over the path's segments; empty segments inside go. What follows ``?`` and ``#``
    is never a path. The page is an address with ``://``. A null page or link gives null.
    """
    # fixed value: the parts of an address as the RFC's pattern takes them
    address = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda text, i: F.regexp_extract(text, "(?s)" + address, i)
    same = F.lower(part(href, 1)) == F.lower(part(page, 1))
    foreign = (part(href, 1) != "") & (~same | href.rlike("^[^:/?#]+://"))
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, query, fragment = part(href, 3), part(href, 4), part(href, 5)
    folder = F.regexp_replace(part(page, 3), "[^/]*$", "")
    whole = F.split(F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "^/", ""), "/")
    last = F.element_at(whole, -1)
    inner = F.filter(F.slice(whole, 1, F.size(whole) - 1), lambda s: s != "")
    segments = F.concat(inner, F.array(last))
    up, here = lambda s: s == "..", lambda s: s == "."
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, s: F.when(up(s), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(here(s), held).otherwise(F.concat(held, F.array(s))),
    )
    stack = F.when(up(last) | here(last), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    merged = F.concat(root, F.lit("/"), F.array_join(stack, "/"), query, fragment)
    return (
        F.when(href == "", page)
        .when(foreign, href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, "^([^:]+:)", 1), href))
        .when(path == "", F.concat(root, part(page, 3), F.when(query != "", query).otherwise(part(page, 4)), fragment))
        .otherwise(merged)
    )


def recordings(rows: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per recording of a language page: files, addresses, entry range, type, year, sequence, information.

    Rows under four td cells, and rows without a file name, are left out. ``pages`` is (key, url).
    """
    t = rows.join(recordings_table(rows, key), [key, "table_idx"], "left_semi")
    head = F.when((F.col("row_idx") == 0) & F.lower("text").rlike("additional|speaker|info"), F.col("col_idx"))
    info = t.groupBy(key).agg(F.min(head).alias("_info"))
    data = t.filter("row_idx > 0 and tag = 'td'").withColumn("i", F.row_number().over(W.Window.partitionBy(key, "row_idx").orderBy("col_idx")) - 1).join(info, key)
    first = lambda test, value: F.min_by(value, F.when(test, F.col("i")))
    last = lambda test, value: F.max_by(value, F.when(test, F.col("i")))
    is_wav = F.lower("href").endswith(".wav")
    is_list = F.col("href").rlike(rf"(?i)({RECORDING_TYPES}).*\.html?")
    span = r"^(\d+)\s*[-–]\s*(\d+)"
    named = F.col("text").rlike(r"(?i)^[a-z]{2,3}_\w+_\d{4}_\d{2}")
    told = (F.length("text") > 15) & F.col("href").isNull() & ~F.col("text").rlike(r"^[\d\s\-–]+$")
    r = data.groupBy(key, "row_idx").agg(
        F.count(F.lit(1)).alias("n"),
        last(is_wav, F.col("href")).alias("_wav"), F.max(is_wav).alias("_has_wav"),
        last(is_list, F.col("href")).alias("_list"), F.max(is_list).alias("_has_list"),
        first(F.col("text").rlike(span), F.col("text")).alias("_span"), F.max(F.col("text").rlike(span)).alias("_has_span"),
        first(named, F.col("text")).alias("_name"), F.max(named).alias("_has_name"),
        first(told, F.col("text")).alias("_told"), F.max(told).alias("_has_told"),
        F.max(F.when((F.col("i") == F.col("_info")) & (F.col("text") != ""), F.col("text"))).alias("_said"),
    )
    some = lambda flag, value: F.when(F.coalesce(F.col(flag), F.lit(False)), value)
    file = F.coalesce(some("_has_wav", F.replace(F.regexp_extract("_wav", "([^/]*)$", 1), F.lit(".wav"), F.lit(""))), some("_has_name", F.col("_name")))
    r = r.filter("n >= 4").withColumn("audio_filename", F.when(file != "", file)).filter("audio_filename is not null").join(pages.select(key, "url"), key)
    tail = r"_(\d{4})_(\d{2})$"
    number = lambda p, g: F.regexp_extract("audio_filename", p, g).try_cast("int")
    kind = F.lower(F.regexp_extract("audio_filename", rf"(?i)_({RECORDING_TYPES})_", 1))
    return r.select(
        key, "row_idx", "audio_filename", resolved(F.col("url"), F.coalesce(some("_has_wav", F.col("_wav")), F.concat("audio_filename", F.lit(".wav")))).alias("wav_url"),
        some("_has_list", resolved(F.col("url"), F.col("_list"))).alias("wordlist_url"),
        some("_has_span", F.regexp_extract("_span", span, 1).try_cast("int")).alias("entry_start"), some("_has_span", F.regexp_extract("_span", span, 2).try_cast("int")).alias("entry_end"),
        F.when(kind != "", kind).alias("recording_type"), number(tail, 1).alias("year"), number(tail, 2).alias("sequence"),
        F.coalesce("_said", some("_has_told", F.col("_told"))).alias("additional_info"),
    )


def wordlist_table(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_idx): the table with most rows, with 50 more for each of rows 1 and 2 that begins with a number."""
    first = F.min(F.when(F.col("row_idx").isin(1, 2) & (F.col("tag") == "td"), F.struct("col_idx", F.col("text").rlike(r"^\d+$").alias("number"))))
    lines = rows.groupBy(key, "table_idx", "row_idx").agg(first.alias("first"))
    t = lines.groupBy(key, "table_idx").agg((F.max("row_idx") + 1).alias("n_rows"), F.sum(F.when(F.col("first.number"), 50).otherwise(0)).alias("bonus"))
    return t.groupBy(key).agg(F.max_by(F.struct("table_idx", "n_rows"), F.struct((F.col("n_rows") + F.col("bonus")).alias("a"), (-F.col("table_idx")).alias("b"))).alias("x")).filter("x.n_rows >= 2").select(key, "x.table_idx")


def column_roles(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n_headers, n_cols, merged, entry_col, ipa_col, english_col, ortho_col, sound_col) of each word list.

    ``rows`` are the cells of one table a page. Headers decide first, then what the first ten rows hold.
    """
    return _roles(rows, [key])


def _roles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The roles of the columns of each table by its keys; texts are summed up before anything moves."""
    h = F.lower("text")
    heads = rows.filter("row_idx = 0").select(
        *keys, "col_idx", h.alias("h"),
        F.when(h.isin(ENTRY_HEADERS), "entry").when(h.contains("transcription") | h.contains("phonetic"), "ipa").when(h.contains("english") | h.contains("gloss"), "english").when(h.contains("orthograph"), "ortho").when(h.contains("sound") | h.contains("phoneme"), "sound").alias("role"),
    )
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("col_idx"))).alias(f"h_{r}")
    named = heads.groupBy(*keys).agg((F.max("col_idx") + 1).alias("n_headers"), *[role(r) for r in ("entry", "ipa", "english", "ortho", "sound")], F.array_sort(F.collect_list(F.struct("col_idx", "h"))).alias("heads"))
    width = rows.filter("row_idx > 0").groupBy(*keys).agg((F.max(F.when(F.col("row_idx") <= 3, F.col("col_idx"))) + 1).alias("w3"), (F.max(F.when(F.col("row_idx") <= 5, F.col("col_idx"))) + 1).alias("w5"))
    digits = F.col("text").rlike(r"^\d+$")
    numbered = rows.filter((F.col("row_idx").between(1, 5)) & digits).groupBy(*keys).agg(F.min_by("col_idx", F.struct("row_idx", "col_idx")).alias("d_entry"))
    score = rows.filter(F.col("row_idx").between(1, 10)).groupBy(*keys, "col_idx").agg(F.count_if(F.col("text").rlike(IPA_CLASS)).alias("ipa"), F.sum(F.length(F.regexp_replace("text", r"[\x00-\x7F]", ""))).alias("beyond"))
    scores = score.groupBy(*keys).agg(F.max_by("col_idx", F.struct("ipa", (-F.col("col_idx")).alias("c"))).alias("s_ipa"), F.max("ipa").alias("s_most"), F.array_sort(F.collect_list(F.struct((-F.col("beyond")).alias("b"), "col_idx"))).alias("by_beyond"))
    m = named.join(width, keys, "left").join(numbered, keys, "left").join(scores, keys, "left")
    m = m.withColumn("n_cols", F.greatest("n_headers", F.coalesce("w3", F.lit(0))))
    m = m.withColumn("ipa1", F.coalesce("h_ipa", F.when(F.col("s_most") > 0, F.col("s_ipa"))))
    m = m.withColumn("entry_col", F.coalesce("h_entry", "d_entry"))
    differs = lambda c, *others: [F.coalesce(c != F.col(o), F.lit(True)) for o in others]
    last = F.col("n_cols") - 1
    a, b = differs(last, "entry_col", "ipa1")
    m = m.withColumn("english_col", F.coalesce("h_english", F.when((F.col("n_cols") > 0) & a & b, last)))
    free = lambda c: F.coalesce(c != F.col("entry_col"), F.lit(True)) & F.coalesce(c != F.col("english_col"), F.lit(True))
    most = F.try_element_at(F.filter("by_beyond", lambda x: free(x["col_idx"])), F.lit(1))["col_idx"]
    header = F.try_element_at(F.filter("heads", lambda x: (x["h"] != "") & ~x["h"].isin([*ENTRY_HEADERS, "english"]) & free(x["col_idx"])), F.lit(1))["col_idx"]
    ipa = F.coalesce("ipa1", F.when(F.col("n_cols") >= 3, most), header)
    merged = (F.col("n_headers") >= 4) & (F.coalesce("w5", F.lit(0)) == 2)
    return m.select(*keys, "n_headers", "n_cols", merged.alias("merged"), "entry_col", ipa.alias("ipa_col"), "english_col", F.col("h_ortho").alias("ortho_col"), F.col("h_sound").alias("sound_col"))


def entries(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_idx, entry_number, ipa, english, orthography, sound_illustrated) of every word-list page.

    Rows need two cells and a transcription or a gloss; where they have an entry text it begins with its number. Texts move once, to the roles of their table.
    """
    table = [key, "table_idx"]
    roles = _roles(rows, table).join(wordlist_table(rows, key), table)
    data = rows.filter("row_idx > 0").join(roles, table)
    at = lambda c: F.max(F.when(F.col("col_idx") == F.col(c), F.when(F.col("text") != "", F.col("text")))).alias(c.removesuffix("_col"))
    one = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("text"))).alias(f"c{i}")
    r = data.groupBy(*table, "row_idx").agg(F.count(F.lit(1)).alias("n"), F.first("merged").alias("merged"), *[at(c) for c in ("entry_col", "ipa_col", "english_col", "ortho_col", "sound_col")], one(0), one(1)).filter("n >= 2")
    number = lambda c: F.when(F.col(c).rlike(r"^\d"), F.regexp_extract(c, r"^(\d+)", 1).try_cast("int"))
    stripped = lambda c: F.when(F.regexp_replace(c, r"(?U)^\s+|\s+$", "") != "", F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    plain = r.filter(~F.col("merged") & (F.col("entry").isNull() | F.col("entry").rlike(r"^\d"))).select(key, "row_idx", number("entry").alias("entry_number"), "ipa", "english", F.col("ortho").alias("orthography"), F.col("sound").alias("sound_illustrated"))
    nbsp, cut = F.col("c1").contains("\xa0"), r"(?s)^(.*[^\x00-\x7F]) (.*)$"
    halves = F.split("c1", "\xa0", 2)
    both = F.when(nbsp, F.struct(stripped(halves[0]).alias("ipa"), stripped(halves[1]).alias("english"))).when(F.col("c1").rlike(cut), F.struct(stripped(F.regexp_extract("c1", cut, 1)).alias("ipa"), stripped(F.regexp_extract("c1", cut, 2)).alias("english"))).otherwise(F.struct(stripped(F.col("c1")).alias("ipa"), F.lit(None).cast("string").alias("english")))
    packed = r.filter(F.col("merged") & F.col("c0").rlike(r"^\d")).withColumn("x", both).select(key, "row_idx", number("c0").alias("entry_number"), "x.ipa", "x.english", stripped(F.regexp_extract("c0", r"(?s)^\d+\s*(.*)$", 1)).alias("orthography"), F.lit(None).cast("string").alias("sound_illustrated"))
    return plain.unionByName(packed).filter("ipa is not null or english is not null")
