"""One query for each operator, and the same result as DuckDB SQL.

The tables hold no Thai text, so Thai inputs are literals or are built from keys
alike on both sides.  Expected tokens in the SQL are literals that were worked
out by hand, or come from a recursive query over the same dictionary.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.segmenting import register, segment, spread
from ..operators.dictionary import Dictionary
from ..operators.prefixes import edges, words_at
from ..operators.registry import Registry
from ..sources.lines import segment_files
from ..sources.shared import new_folder
from ..streaming.lines import line_stream, segment_stream
from .native import plain_tokens, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SELECT of literal rows."""
    each = ", ".join("(" + ", ".join(literal(v) if v is None or isinstance(v, str) else f"CAST({v} AS BIGINT)" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {each}) AS t({names})"


# --- dictionaries -------------------------------------------------------------

#: Part names cut into words, padded in several ways.
_PADDED = "CASE size % 4 WHEN 0 THEN word WHEN 1 THEN concat('  ', word, chr(9)) WHEN 2 THEN concat(chr(160), word, ' ') ELSE concat(chr(10), word, chr(13)) END"
_PART_WORDS = "SELECT p_size AS size, explode(split(p_name, ' ')) AS word FROM part"
_DUCK_PART_WORDS = "SELECT p_size AS size, unnest(string_split(p_name, ' ')) AS word FROM part"
_DUCK_TRIM = "regexp_replace(w, '^[" + P.TRIMMED + "]+|[" + P.TRIMMED + "]+$', '', 'g')"
_DUCK_WORDS = f"SELECT DISTINCT {_DUCK_TRIM} AS word FROM (SELECT {_PADDED} AS w FROM ({_DUCK_PART_WORDS})) WHERE {_DUCK_TRIM} <> ''"


def _part_dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    words = table(spark, sf_dir, "part").selectExpr("p_size AS size", "explode(split(p_name, ' ')) AS word")
    return Dictionary.from_column(words.selectExpr(f"{_PADDED} AS w"), "w")


@query(_DUCK_WORDS)
def dict_words(spark, sf_dir):
    return _part_dictionary(spark, sf_dir).words


@query(f"SELECT word FROM ({_DUCK_WORDS}) UNION SELECT DISTINCT n_name AS word FROM nation UNION SELECT 'ศาลา' AS word")
def dict_add(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name")
    return _part_dictionary(spark, sf_dir).add(names).add(["  ศาลา ", "", " \t"]).words


@query(f"SELECT word FROM ({_DUCK_WORDS}) WHERE word NOT IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size < 5)")
def dict_remove(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size < 5").select(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w"))
    return _part_dictionary(spark, sf_dir).remove(gone).remove(["absent"]).words


@query(f"WITH d AS ({_DUCK_WORDS}) SELECT DISTINCT w.word, w.word IN (SELECT word FROM d) AS contained FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT concat(split_part(p_name, ' ', 1), ' ') FROM part) w")
def dict_contains(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    first = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    rows = words.union(first).union(first.select(F.concat("word", F.lit(" ")))).distinct()
    return _part_dictionary(spark, sf_dir).contains(rows, "word")


@query(f"SELECT count(*) AS n_words FROM ({_DUCK_WORDS})")
def dict_count(spark, sf_dir):
    return _part_dictionary(spark, sf_dir).words.agg(F.count("*").alias("n_words"))


@query(
    """
    WITH d AS (SELECT DISTINCT left(w, n) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part), range(2, 7) r(n)),
    t AS (SELECT DISTINCT p_name FROM part)
    SELECT p_name, CAST(pos AS INTEGER) AS pos, word, CAST(pos + length(word) AS INTEGER) AS "end"
    FROM t, range(0, 200) r(pos), d WHERE pos < length(p_name) AND starts_with(substring(p_name, pos + 1), word)
    """
)
def prefix_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = names.select(F.explode(F.split("p_name", " ")).alias("w")).select(F.explode(F.sequence(F.lit(2), F.lit(6))).alias("n"), "w")
    return words_at(names, "p_name", "p_name", Dictionary.from_column(words.select(F.expr("left(w, n)").alias("w")), "w"))


# --- clusters and runs --------------------------------------------------------

# The words of the two small dictionaries of the test inputs.
WORDS = ("ค่า", "ค่าจ้าง", "ค่าจ้างเพื่อชีวิต", "ค่าแรง", "ค่ายทหาร", "คน", "ไข่", "ปฏิวัติ", "ปฏิรูป", "ปฏิเสธ", "ปฏิบัติ")
_LIST = "[" + ", ".join(map(literal, WORDS)) + "]"
_SPARK_LIST = "array(" + ", ".join(map(literal, WORDS)) + ")"
_DUCK_THAI = f"concat({_LIST}[1 + c_custkey % 11], {_LIST}[1 + (c_custkey // 11) % 11], {_LIST}[1 + (c_custkey // 121) % 11])"


def _thai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey and three dictionary words that its digits in base 11 choose."""
    word = lambda k: f"element_at({_SPARK_LIST}, CAST(1 + (c_custkey div {k}) % 11 AS INT))"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat({word(1)}, {word(11)}, {word(121)}) AS text")


_DUCK_CLUSTERS = f"regexp_extract_all(text, {literal(P.cluster_pattern(look_ahead=False).replace('[\\s\\S]', '(?s:.)'))})"


@query(f"SELECT c_custkey, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, unnest(c) AS cluster FROM (SELECT c_custkey, {_DUCK_CLUSTERS} AS c FROM (SELECT c_custkey, {_DUCK_THAI} AS text FROM customer))")
def clusters(spark, sf_dir):
    return _thai(spark, sf_dir).select("c_custkey", F.posexplode(X.clusters("text")).alias("pos", "cluster"))


CLUSTER_CASES = {"พิสูจน์ได้ค่ะ": (2, 7, 10, 13), "เรือน้อยลอยอยู่": (4, 6, 7, 8, 9, 10, 11, 12, 15), "เบียร์": (5, 6), "เบียร์😀": (5, 6, 7)}


@query(values([(t, b) for t, bounds in CLUSTER_CASES.items() for b in bounds], "text, bound"))
def cluster_bounds(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in CLUSTER_CASES], "text string")
    return rows.select("text", F.explode(X.cluster_bounds("text").cast("array<long>")).alias("bound"))


_WORDS_SQL = "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents"
_DUCK_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(word, '^(?:{p})') THEN '{n}'" for n, p in zip(P.RUN_NAMES, P.RUNS)) + " END"


@query(f"SELECT word, {_DUCK_CLASS} AS class, coalesce(regexp_extract(word, '^(?:{P.RUN})'), '') AS run, regexp_matches(word, '{P.BARE_CONSONANTS}') AS bare FROM ({_WORDS_SQL} UNION SELECT unnest(['ก', 'กข', 'กขค', 'กา', '๑๒.๓ก', ' ก', chr(10), chr(13)]) AS word)")
def pattern_class(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    more = spark.createDataFrame([(w,) for w in ("ก", "กข", "กขค", "กา", "๑๒.๓ก", " ก", "\n", "\r")], "word string")
    words = words.union(more).distinct()
    return words.select("word", X.run_class("word").alias("class"), X.leading_run("word").alias("run"), X.is_bare_consonants("word").alias("bare"))


_DUCK_EDGES = f"""
    t AS (SELECT c_custkey, {_DUCK_THAI} AS text FROM customer),
    ends AS (SELECT c_custkey, list_sum(list_transform(c[1:i], lambda x: length(x))) AS e FROM (SELECT c_custkey, {_DUCK_CLUSTERS} AS c FROM t), range(1, 100) r(i) WHERE i <= len(c)),
    edges AS (SELECT t.c_custkey, pos, word, pos + length(word) AS e FROM t, range(0, 100) r(pos), unnest({_LIST}) d(word)
              WHERE pos < length(text) AND starts_with(substring(text, pos + 1), word)
              AND EXISTS (SELECT 1 FROM ends WHERE ends.c_custkey = t.c_custkey AND ends.e = pos + length(word)))
"""


def _word_dictionary(spark: SparkSession) -> Dictionary:
    return Dictionary.from_words(spark, WORDS)


@query(f'WITH {_DUCK_EDGES} SELECT c_custkey, CAST(pos AS INTEGER) AS pos, word, CAST(e AS INTEGER) AS "end" FROM edges')
def boundary_filter(spark, sf_dir):
    return edges(_thai(spark, sf_dir), "c_custkey", "text", _word_dictionary(spark))


@query("SELECT doc_id, length(text) AS n, substring(text, 11, 20) AS piece, substring(text, 6, 1) AS c, CASE WHEN instr(reverse(text), ' ') > 0 THEN length(text) - instr(reverse(text), ' ') END AS last_space, length(text) = 0 AS empty FROM documents")
def char_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.chars_len("text").cast("long").alias("n"), X.char_slice("text", 10, 30).alias("piece"), X.char_at("text", 5).alias("c"), X.last_space("text").cast("long").alias("last_space"), X.is_empty("text").alias("empty"))


# --- segmentation -------------------------------------------------------------


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{P.PLAIN_SCAN}')) AS token FROM documents) GROUP BY token")
def scan_nodict(spark, sf_dir):
    """All documents with an empty dictionary, as counts of tokens."""
    return token_counts(table(spark, sf_dir, "documents").select(F.explode(plain_tokens("text")).alias("token")))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{P.PLAIN_SCAN}')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def token_top_k(spark, sf_dir):
    return scan_nodict(spark, sf_dir).orderBy(F.desc("n"), "token").limit(20)


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{P.PLAIN_SCAN}') AS t FROM documents)")
def segment_documents(spark, sf_dir):
    """All documents through the lattice, with a dictionary that they don't use."""
    tokens = segment("text", _word_dictionary(spark))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(X.joined("t")).alias("digest"))


_DUCK_PATHS = f"""
    WITH RECURSIVE {_DUCK_EDGES},
    paths(c_custkey, place, ends, tokens) AS (
        SELECT c_custkey, 0::BIGINT, []::BIGINT[], []::VARCHAR[] FROM t
        UNION ALL
        SELECT p.c_custkey, g.e, list_append(p.ends, g.e), list_append(p.tokens, g.word) FROM paths p JOIN edges g ON g.c_custkey = p.c_custkey AND g.pos = p.place
    ),
    best AS (SELECT c_custkey, arg_min(tokens, {{'n': len(ends), 'ends': ends}}) AS tokens FROM paths p JOIN t USING (c_custkey) WHERE p.place = length(text) GROUP BY c_custkey)
"""


@query(f"{_DUCK_PATHS} SELECT c_custkey, CAST(generate_subscripts(tokens, 1) - 1 AS BIGINT) AS pos, unnest(tokens) AS token FROM best")
def segment_constructed(spark, sf_dir):
    """Each customer's text of dictionary words, as rows."""
    return _thai(spark, sf_dir).select("c_custkey", F.posexplode(segment("text", _word_dictionary(spark))).alias("pos", "token")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "token")


@query(f"{_DUCK_PATHS} SELECT c_custkey, CAST(generate_subscripts(tokens, 1) - 1 AS BIGINT) AS pos, unnest(tokens) AS token FROM best")
def segment_rows(spark, sf_dir):
    """The same by the table function in SQL."""
    register(spark, _word_dictionary(spark), "thai_segment")
    _thai(spark, sf_dir).createOrReplaceTempView("thai_segment_input")
    return spark.sql("SELECT c_custkey, r.pos, r.token FROM thai_segment_input, LATERAL thai_segment_rows(text) r")


@query(f"{_DUCK_PATHS} SELECT c_custkey, array_to_string(tokens, '|') AS line FROM best")
def line_output(spark, sf_dir):
    return _thai(spark, sf_dir).select("c_custkey", X.joined(segment("text", _word_dictionary(spark))).alias("line"))


#: text -> tokens; the dictionary holds the Thai words among the tokens and CASE_WORDS.
CASES: dict[str, tuple[str, ...]] = {
    " ": (" ",),
    "ไข่คน2021": ("ไข่", "คน", "2021"),
    "1) ประมวลผลภาษาไทย": ("1", ")", " ", "ประมวลผล", "ภาษาไทย"),
    "มาตรา39": ("มาตรา", "39"),
    "19...": ("19", "..."),
    "19.": ("19", "."),
    "19.84": ("19.84",),
    "127.0.0.1": ("127.0.0.1",),
    "USD1,984.42": ("USD", "1,984.42"),
    "๑๙...": ("๑๙", "..."),
    "๑๙.๘๔": ("๑๙.๘๔",),
    "๑๒๗.๐.๐.๑": ("๑๒๗.๐.๐.๑",),
    "USD๑,๙๘๔.๔๒": ("USD", "๑,๙๘๔.๔๒"),
    "นิสสันผ่อนจนเพลียนาวาร่า..": ("นิสสัน", "ผ่อน", "จน", "เพลีย", "นาวา", "ร่า", ".."),
    "ห้องสมุดประชาชนเทศบาลตำบลวิชิต": ("ห้องสมุด", "ประชา", "ชน", "เทศบาลตำบล", "วิชิต"),
}
CASE_WORDS = ("ประมวลผล", "ภาษาไทย", "มาตรา", "นิสสัน", "ผ่อน", "จน", "เพลีย", "นาวา", "ร่า", "ห้องสมุด", "ประชา", "ชน", "เทศบาลตำบล", "วิชิต")


def _tokens(spark: SparkSession, texts, dictionary: Dictionary, safe: bool = False) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return rows.select("text", F.posexplode(segment("text", dictionary, safe)).alias("pos", "token")).select("text", F.col("pos").cast("long").alias("pos"), "token")


def _expected(cases: dict[str, tuple[str, ...]]) -> str:
    return values([(text, pos, token) for text, tokens in cases.items() for pos, token in enumerate(tokens)], "text, pos, token")


@query(_expected(CASES))
def segment_golden(spark, sf_dir):
    return _tokens(spark, CASES, Dictionary.from_words(spark, WORDS + CASE_WORDS))


# Runs that the dictionary doesn't have end before a word of more than two bare
# consonants, before a run, or with the text; 42 is a word, so it wins over 42.5.
UNKNOWN = {
    "ฟฟฟไข่": ("ฟฟฟ", "ไข่"),
    "ฟฟฟคน": ("ฟฟฟคน",),
    "ฟฟฟ12": ("ฟฟฟ", "12"),
    "!!ไข่": ("!!", "ไข่"),
    "42.5": ("42", ".", "5"),
    "xไข่": ("x", "ไข่"),
    "a\r\nb\rc": ("a", "\r\n", "b", "\r", "c"),
}


@query(_expected(UNKNOWN))
def segment_unknown(spark, sf_dir):
    return _tokens(spark, UNKNOWN, Dictionary.from_words(spark, (*WORDS, "42")))


# Fifty unknown tokens in a row leave no room: the next position keeps its
# shortest word.  One fewer, and the longer word is an edge too.
_FIFTY = ",a" * 25
CAPPED = {
    _FIFTY + "ค่าจ้าง": (*((",", "a") * 25), "ค่า", "จ้าง"),
    _FIFTY[1:] + "ค่าจ้าง": (*((",", "a") * 25)[1:], "ค่าจ้าง"),
}


@query(_expected(CAPPED))
def segment_cap(spark, sf_dir):
    return _tokens(spark, CAPPED, _word_dictionary(spark))


# A last space at 20 of the sample ends the part after 21 characters of the
# text; without a space the part ends before the sample's last longest token.
_SAFE_SPACED = "ก" * 120 + " " + "ข" * 30
_SAFE_WORDS = "ไข่คน" * 30
SAFE = {
    _SAFE_SPACED: ("ก" * 21, "ก" * 99, " ", "ข" * 30),
    _SAFE_WORDS: ("ไข่", "คน") * 30,
}


@query(_expected(SAFE))
def segment_safe(spark, sf_dir):
    return _tokens(spark, SAFE, _word_dictionary(spark), safe=True)


@query("SELECT 'null' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'blank', 1")
def segment_null_empty(spark, sf_dir):
    rows = spark.createDataFrame([("null", None), ("empty", ""), ("blank", "  ")], "name string, text string")
    return rows.select("name", F.size(segment("text", _word_dictionary(spark))).cast("long").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{P.PLAIN_SCAN}')) AS n_tokens FROM documents")
def stream_documents(spark, sf_dir):
    """Documents as a stream, segmented and written, then read as a table."""
    out = new_folder(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # a stream reads folders; the table is a file or a folder of files
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    tokens = docs.select("doc_id", F.size(plain_tokens("text")).cast("long").alias("n_tokens"))
    tokens.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/table").awaitTermination()
    return spark.read.schema("doc_id long, n_tokens long").parquet(f"{out}/table")


# --- dictionary files, the registry, line jobs --------------------------------


def _word_file(spark: SparkSession, words: DataFrame) -> str:
    """A folder of word files, one word a line."""
    path = new_folder(spark, "words")
    words.write.text(path)
    return path


@query(_DUCK_WORDS)
def dict_file(spark, sf_dir):
    """Padded and repeated words in files, read as a dictionary."""
    names = table(spark, sf_dir, "part").selectExpr("p_size AS size", "explode(split(p_name, ' ')) AS word")
    return Dictionary.from_file(spark, _word_file(spark, names.selectExpr(f"{_PADDED} AS value"))).words


_NAMES = ("a-b", "my dict", "ไทย")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true, false, 6, 7, 'ไข่|คน')" for n in _NAMES) + ") t(name, loaded, again, n_before, n_after, tokens)")
def dict_registry(spark, sf_dir):
    """Names of any kind; a name is given once; added words are found at once."""
    known, rows = Registry(spark), []
    path = _word_file(spark, spark.createDataFrame([(w,) for w in WORDS[:6]], "value string"))
    for name in _NAMES:
        loaded, again, before = known.load_dict(path, name)[1], known.load_dict(path, name)[1], known.dictionary(name).count()
        known.add(name, ["ไข่"])
        rows.append((name, loaded, again, before, known.dictionary(name).count(), "|".join(known.segment("ไข่คน", name))))
    return spark.createDataFrame(rows, "name string, loaded boolean, again boolean, n_before int, n_after int, tokens string")


_DUCK_LINES = f"SELECT line, count(*) AS n FROM (SELECT concat({_LIST}[1 + c_custkey % 11], '|', {_LIST}[1 + (c_custkey // 11) % 11], '|', {_LIST}[1 + (c_custkey // 121) % 11]) AS line FROM customer) GROUP BY line"


def _counted_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(_DUCK_LINES)
def line_job(spark, sf_dir):
    """Text files in, delimited text files out, with a dictionary file."""
    source, target = new_folder(spark, "lines"), new_folder(spark, "segmented")
    _thai(spark, sf_dir).select("text").write.text(source)
    segment_files(spark, source, target, _word_file(spark, spark.createDataFrame([(w,) for w in WORDS], "value string")))
    return _counted_lines(spark.read.text(target))


@query(_DUCK_LINES)
def line_stream_job(spark, sf_dir):
    """The same as a stream."""
    source, target = new_folder(spark, "lines"), new_folder(spark, "streamed")
    _thai(spark, sf_dir).select("text").write.text(source)
    segment_stream(line_stream(spark, source), _word_dictionary(spark), target, f"{target}-checkpoint", once=True).awaitTermination()
    return _counted_lines(spark.read.text(target))


# Words of three syllables, each a consonant with one vowel: 64,000 of them, as
# many as a real dictionary has.
_SYLLABLES = 40


def _word_sql(number: str) -> str:
    k = [f"({number}) % 40", f"(({number}) // 40) % 40", f"(({number}) // 1600) % 40"]
    return "concat(" + ", ".join(f"chr(CAST(3585 + {x} AS INTEGER)), 'า'" for x in k) + ")"


def _numbered_word(number: str) -> str:
    k = [f"({number}) % 40", f"(({number}) div 40) % 40", f"(({number}) div 1600) % 40"]
    letters = "array(" + ", ".join(f"'{chr(3585 + i)}า'" for i in range(_SYLLABLES)) + ")"
    return "concat(" + ", ".join(f"element_at({letters}, CAST(1 + {x} AS INT))" for x in k) + ")"


_KEYS = ("l_partkey * 7919", "l_suppkey * 104729", "l_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, concat_ws('|', {', '.join(_word_sql(k) for k in _KEYS)}) AS tokens FROM lineitem")
def segment_large_dictionary(spark, sf_dir):
    """Three words each of a dictionary of 64,000."""
    words = spark.range(_SYLLABLES**3).selectExpr(f"{_numbered_word('id')} AS word")
    rows = spread(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"concat({', '.join(_numbered_word(k) for k in _KEYS)}) AS text"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(segment("text", Dictionary.from_column(words, "word")), "|").alias("tokens"))


#: Texts made to be slow or hard: long runs without a space of bare consonants,
#: repeated words, leading vowels and marks.
_HARD = ("ก", "กา", "ค่าจ้าง", "เ", "์", "ก็", "ปฏิวัติปฏิรูป", "ab1 ", "ไข่คน")


@query("SELECT CAST(i AS INTEGER) AS i, safe, true AS whole FROM range(0, %d) r(i), (VALUES (true), (false)) s(safe)" % len(_HARD))
def segment_hard_texts(spark, sf_dir):
    """20,000 characters or more each, in both modes: the tokens are the text."""
    rows = spark.createDataFrame([(i, t * (20_000 // len(t) + 1)) for i, t in enumerate(_HARD)], "i int, text string")
    words = _word_dictionary(spark).add(["กก", "กกก"])
    return reduce(DataFrame.union, [rows.select("i", F.lit(safe).alias("safe"), (F.array_join(segment("text", words, safe), "") == F.col("text")).alias("whole")) for safe in (True, False)])
