"""The registered queries and, beside each, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import layers, syllable
from quern.functions.tokens import ALPHA, MAX_KEY_BYTES, OTHER, in_set
from quern.operators import bpe, count
from quern.sources.corpus import documents, shuffled

#: Vietnamese words and near misses; the test tables hold none.
FIXTURE = "gịu gìa qùa coa quô quôc cuôc nh nz hòa hoà thuở huơ khuya chuyện yêu iêu tiếng Việt NGHIÊNG nghe ghê gì gím gin giếng giêng quy qui quý quả quốc boong đường ăn áo ái aí oái oaí toàn tuần tuệ của cùa mía lửa người mười xoong khuỷu quyết chuyên ngủ kẻ ke cá cac các cách cạch cach em anh inh ich ông a ă y ý uy z f w j q qu gi g gh ngh đ đi Đà thúy thuý họp hop an la é".split()
#: Merges of a real vocabulary, and the first few of them, as many as the unrolled SQL compares.
K, FIRST = 8000, 6


def _rows(words) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def _fixture(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_rows(FIXTURE)} AS t(token)")


SPLIT = f"SELECT unnest(regexp_extract_all(text, '{ALPHA}')) AS token FROM documents"
SPLIT_OTHER = f"SELECT unnest(regexp_extract_all(text, '{OTHER}')) AS token FROM documents"
COUNT = "SELECT token, count(*) AS cnt FROM ({}) WHERE strlen(token) <= 32 GROUP BY token"
ALL = f"(SELECT token, count(*) AS cnt FROM ({SPLIT}) GROUP BY token)"
PARSED = layers.sql(layers.sql(ALL, syllable.parse()), syllable.ENCODE)
TYPES = f"(SELECT token, cnt FROM {PARSED} WHERE NOT can_be_vietnamese AND strlen(token) <= {MAX_KEY_BYTES})"
IDS = f"(SELECT range AS syll_id FROM range({syllable.MAX_ID}))"
SPELLED = layers.sql(layers.sql(IDS, syllable.DECODE), syllable.SPELL)
NORMAL = f"(SELECT DISTINCT text, n_dau AS am_dau, n_giua AS am_giua, n_cuoi AS am_cuoi, tone FROM {layers.sql(SPELLED, syllable.NORMAL)} WHERE sounds)"
LEXICON = layers.sql(NORMAL, syllable.ENCODE)
PARTS = ["token", "can_be_vietnamese", "am_dau", "am_giua", "am_cuoi", "tone", "syll_id"]
VOCAB = f"(SELECT token, cnt, regexp_replace(hex(encode(token)), '(..)', '<\\1>', 'g') AS sym FROM {TYPES})"


def _pairs(vocab: str) -> str:
    return f"SELECT p.l AS \"left\", p.r AS \"right\", CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT cnt, unnest(list_transform(range(1, len(s)), lambda i: {{'l': s[i], 'r': s[i + 1]}})) AS p FROM (SELECT cnt, regexp_extract_all(sym, '<[0-9A-F]+>') AS s FROM {vocab})) GROUP BY 1, 2"


def _learn(k: int) -> str:
    """The first k merges as a chain of tables b0.. (best pairs) and v0.. (vocabularies)."""
    out = [f"v0 AS MATERIALIZED {VOCAB}"]
    for i in range(k):
        out.append(f"b{i} AS MATERIALIZED (SELECT {i} AS rank, * FROM ({_pairs(f'v{i}')}) ORDER BY cnt DESC, \"left\", \"right\" LIMIT 1)")
        out.append(f"v{i + 1} AS MATERIALIZED (SELECT token, v.cnt, replace(sym, b.\"left\" || b.\"right\", left(b.\"left\", -1) || substr(b.\"right\", 2)) AS sym FROM v{i} AS v, b{i} AS b)")
    return "WITH " + ", ".join(out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent entries of both counters: syllables by canonical text, other words as they are."""
    parsed = count.routed(documents(spark, sf_dir)).filter(f"can_be_vietnamese or octet_length(token) <= {MAX_KEY_BYTES}")
    by = parsed.groupBy("syll_id", F.when(F.col("syll_id").isNull(), F.col("token")).alias("token")).agg(F.sum("cnt").alias("cnt"))
    return by.orderBy(F.desc("cnt"), F.asc_nulls_first("syll_id"), "token").limit(300)


def token_route(spark, sf):
    kind = F.when(F.col("can_be_vietnamese"), "syllable").when(F.octet_length("token") <= MAX_KEY_BYTES, "token").otherwise("too long")
    return count.routed(documents(spark, sf)).groupBy(kind.alias("kind")).agg(F.count("*").alias("types"), F.sum("cnt").alias("tokens"))


def type_stats(spark, sf):
    t = count.alpha(documents(spark, sf)).withColumn("b", F.octet_length("token"))
    short = F.col("b") <= 8
    return t.agg(F.count("*").alias("types"), F.sum("cnt").alias("puts"), F.sum("b").cast("long").alias("bytes"), F.count(F.when(short, 1)).alias("short_types"), F.sum(F.when(short, F.col("cnt"))).alias("short_puts"), F.sum(F.when(short, F.col("b"))).cast("long").alias("short_bytes"), F.max(F.length("token")).cast("long").alias("longest"))


def char_decode(spark, sf):
    chars = documents(spark, sf).select(F.explode(F.split("text", "")).alias("ch")).filter("ch != ''").groupBy("ch").agg(F.count("*").alias("cnt"))
    return layers.apply(chars, CHARS).select("ch", "cnt", "base", "tone", "vowel", "upper", "bytes")


CHARS = [syllable.letters("ch"), {"tone": "CASE WHEN tones IN ('1', '2', '3', '4', '5') THEN CAST(tones AS INT) ELSE 0 END", "vowel": f"base IN {syllable.VOWEL}", "upper": f"instr('{syllable.UPPER}', ch) > 0", "bytes": "CAST({BYTES}(ch) AS BIGINT)"}]


def lookup(spark, sf):
    got = count.alpha(documents(spark, sf)).filter(F.col("token").isin("the", "de", "la"))
    keys = spark.sql("SELECT * FROM VALUES ('the'), ('de'), ('la'), ('absent word') AS t(token)")
    return keys.join(F.broadcast(got), "token", "left").select("token", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def selfcheck(spark, sf):
    """Entries whose spelling, looked up again, leads to another id: none, if each spelling has one."""
    lex = count.lexicon(spark)
    again = lex.select(F.col("text").alias("token"), F.col("syll_id").alias("found"))
    return lex.join(F.broadcast(again), F.col("text") == F.col("token")).filter("found <> syll_id").select(F.col("syll_id").alias("id"), "token", F.col("found").alias("syll_id"))


def learnt(spark, sf, k=K, dropout=0.0):
    """Merges in order; symbol: the bytes of the new symbol in hex, text: as UTF-8, null where they are none by themselves."""
    merges, _ = bpe.learn(count.types(documents(spark, sf)), k, dropout, 7)
    out = spark.createDataFrame(merges, "rank int, left string, right string, cnt long").withColumn("symbol", F.concat(F.expr("substr(left, 2, length(left) - 2)"), F.expr("substr(right, 2, length(right) - 2)")))
    return out.withColumn("text", F.expr("try_validate_utf8(cast(unhex(symbol) as string))"))


def respelled(spark, sf):
    """Ids that, spelled, parsed and spelled again, have another text and other parts; helper nuclei, q and doubled i or o are left out."""
    ids = spark.range(syllable.MAX_ID).select(F.col("id").alias("syll_id"))
    lex = count.spelled(ids).filter(COMPARED).select(F.col("syll_id").alias("id"), F.col("text").alias("token"), F.col("am_giua").alias("giua"), F.col("am_cuoi").alias("cuoi"), F.col("tone").alias("ton0"))
    again = count.spelled(layers.apply(layers.apply(lex, syllable.parse()), syllable.ENCODE).select("id", "token", "giua", "cuoi", "ton0", "syll_id"))
    return again.filter(OTHERWISE).select("id", "token", F.expr("CASE WHEN syll_id IS NOT NULL THEN text END").alias("again"), "syll_id")


COMPARED = "am_giua NOT IN ('ah', 'oah') AND NOT (am_giua = 'i' AND am_cuoi = 'i') AND NOT (am_giua = 'o' AND am_cuoi = 'o') AND am_dau <> 'q'"
OTHERWISE = "text <> token AND (am_giua <> giua OR am_cuoi <> cuoi OR tone <> ton0)"
AGAIN = f"(SELECT id, token, giua, cuoi, ton0, syll_id FROM {layers.sql(layers.sql(f'(SELECT syll_id AS id, text AS token, am_giua AS giua, am_cuoi AS cuoi, tone AS ton0 FROM {SPELLED} WHERE {COMPARED})', syllable.parse()), syllable.ENCODE)})"
ASKED_IDS, ASKED_PAIRS = [0, 36, 1176, 29399], [("<74>", "<68>"), ("<65>", "<72>"), ("<00>", "<00>")]


def syllable_lookup(spark, sf):
    keys = spark.sql(f"SELECT CAST(id AS BIGINT) AS syll_id FROM VALUES {', '.join(f'({i})' for i in ASKED_IDS)} AS t(id)")
    got = count.syllables(documents(spark, sf)).filter(F.col("syll_id").isin(ASKED_IDS))
    return keys.join(F.broadcast(got), "syll_id", "left").select("syll_id", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def pair_lookup(spark, sf):
    keys = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, ASKED_PAIRS))} AS t(left, right)")
    counted = bpe.pairs(bpe.vocabulary(count.types(documents(spark, sf)))).filter(" OR ".join(f"left = '{a}' AND right = '{b}'" for a, b in ASKED_PAIRS))
    return keys.join(F.broadcast(counted), ["left", "right"], "left").select("left", "right", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def encoded(spark, sf, k=K):
    """All words as the symbols that the learnt merges make of them."""
    words = bpe.store(count.alpha(documents(spark, sf)))
    merges, _ = bpe.learn(count.unparsed(words), k)
    return bpe.encode(words, merges)


def _encode(k: int) -> str:
    sym = "regexp_replace(hex(encode(token)), '(..)', '<\\1>', 'g')"
    for i in range(k):
        pick = lambda e, i=i: f"(SELECT {e} FROM b{i})"
        sym = f"replace({sym}, {pick('\"left\" || \"right\"')}, {pick('left(\"left\", -1) || substr(\"right\", 2)')})"
    return f"{_learn(k)} SELECT token, cnt, {sym} AS sym FROM ({COUNT.format(SPLIT)})"


def lookup_kind(spark, sf):
    t = count.alpha(documents(spark, sf))
    return t.select("token", F.col("token").rlike("^[eyuioa]").alias("vowel_start"), F.col("token").rlike("^[mncptMNCPT]").alias("final_consonant_start"), F.octet_length("token").cast("long").alias("bytes"), F.length("token").cast("long").alias("chars"))


_alpha = lambda s, d: count.alpha(documents(s, d))
_fix = lambda s: layers.apply(layers.apply(_fixture(s), syllable.parse()), syllable.ENCODE)
FIX = layers.sql(layers.sql(f"(SELECT * FROM (VALUES {_rows(FIXTURE)}) AS t(token))", syllable.parse()), syllable.ENCODE)
TOP = "SELECT token, cnt FROM ({}) ORDER BY cnt DESC, token LIMIT {}"
FEATURES = [syllable.FEATURES, syllable.WHOLE]
_features = ["syll_id", "text", *syllable.FEATURES, *syllable.WHOLE]

#: Shapes of text that a scanner meets, and by hand what it finds in them: words, and other pieces.
LINES = [
    ('" Bē12hance"  MỘT con', ["Bē", "hance", "MỘT", "con"], ['"', "12", '"']),
    ("123ngoan9012mo67", ["ngoan", "mo"], ["123", "9012", "67"]),
    ("234 ?/$#%hoa#$%quả\t  sơn!!!", ["hoa", "quả", "sơn"], ["234", "?/$#%", "#$%", "!!!"]),
    ("\U0001f917Cần n\U0001f4a5chọn", ["\U0001f917Cần", "n\U0001f4a5chọn"], []),
    ("họ\u0323 c\u1ecd\u0301", ["họ\u0323", "c\u1ecd\u0301"], []),
    ("nghe \u2013 trong,đó;", ["nghe", "\u2013", "trong", "đó"], [",", ";"]),
    ("a{b|c}~ \ufffdx", ["a{b|c}~", "\ufffdx"], []),
    ("Gả ļo Άθ\n\n", ["Gả", "ļo", "Άθ"], []),
    (" \t\n", [], []),
    ("", [], []),
]


def scanned(spark, sf):
    """The words and other pieces of each line, in order."""
    lines = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "line int, text string")
    one = lambda kind, pattern: lines.select("line", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "piece"))
    return one("word", ALPHA).unionByName(one("other", OTHER))


SCANNED = "SELECT CAST(line AS INT) AS line, kind, CAST(place AS INT) AS place, piece FROM (VALUES " + ", ".join(f"({i}, '{kind}', {k}, '{piece}')" for i, x in enumerate(LINES) for kind, pieces in (("word", x[1]), ("other", x[2])) for k, piece in enumerate(pieces)) + ") AS t(line, kind, place, piece)"
#: Surface, then initial, nucleus, final and tone as they must come out; None: no syllable.
CASES = [
    ("gịu", "g", "i", "u", "j"), ("gìa", "g", "iez", "_none", "f"), ("qùa", "c", "oa", "_none", "f"), ("qua", "c", "oa", "_none", "_none"), ("coa", "c", "oa", "_none", "_none"),
    ("quô", None, None, None, None), ("quôc", None, None, None, None), ("cuôc", None, None, None, None), ("nh", None, None, None, None), ("nz", None, None, None, None),
    ("nghiêng", "ng", "iez", "ng", "_none"), ("thuở", "th", "u_ow", "_none", "r"), ("đường", "zd", "uow", "ng", "f"), ("khuya", "kh", "uyez", "_none", "_none"), ("gì", "gi", "i", "_none", "f"), ("toàn", "t", "oa", "n", "f"),
]


def cases(spark, sf):
    given = spark.createDataFrame([(x[0],) for x in CASES], "token string")
    return layers.apply(given, syllable.parse()).select("token", "can_be_vietnamese", "am_dau", "am_giua", "am_cuoi", "tone")


CASES_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(["'" + x[0] + "'", str(x[1] is not None).lower(), *("NULL" if v is None else f"'{v}'" for v in x[1:])]) + ")" for x in CASES) + ") AS t(token, can_be_vietnamese, am_dau, am_giua, am_cuoi, tone)"


def many_files(spark, sf):
    """Token counts over the texts of several files, read as one corpus."""
    return count.alpha(spark.read.schema("text string").parquet(f"{sf}/documents.parquet", f"{sf}/conversations.parquet"))


_table = {
    "alpha_tokens": (lambda s, d: count.split(documents(s, d)), SPLIT),
    "nonalpha_tokens": (lambda s, d: count.split(documents(s, d), OTHER), SPLIT_OTHER),
    "token_counts": (_alpha, COUNT.format(SPLIT)),
    "nonalpha_counts": (lambda s, d: count.other(documents(s, d)), COUNT.format(SPLIT_OTHER)),
    "top_types": (lambda s, d: _alpha(s, d).orderBy(F.desc("cnt"), "token").limit(300), TOP.format(COUNT.format(SPLIT), 300)),
    "longest_types": (lambda s, d: _alpha(s, d).orderBy(F.desc(F.octet_length("token")), "token").limit(20), f"SELECT token, cnt FROM ({COUNT.format(SPLIT)}) ORDER BY strlen(token) DESC, token LIMIT 20"),
    "word_count": (lambda s, d: documents(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "word"), r"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents) GROUP BY word ORDER BY cnt DESC, word"),
    "distinct_types": (lambda s, d: _alpha(s, d).agg(F.count("*").alias("types")), f"SELECT count(*) AS types FROM ({COUNT.format(SPLIT)})"),
    "type_stats": (type_stats, f"SELECT count(*) AS types, CAST(sum(cnt) AS BIGINT) AS puts, CAST(sum(strlen(token)) AS BIGINT) AS bytes, count(CASE WHEN strlen(token) <= 8 THEN 1 END) AS short_types, CAST(sum(CASE WHEN strlen(token) <= 8 THEN cnt END) AS BIGINT) AS short_puts, CAST(sum(CASE WHEN strlen(token) <= 8 THEN strlen(token) END) AS BIGINT) AS short_bytes, max(length(token)) AS longest FROM ({COUNT.format(SPLIT)})"),
    "token_lookup": (lookup, f"SELECT k.token, coalesce(c.cnt, 0) AS cnt FROM (VALUES ('the'), ('de'), ('la'), ('absent word')) AS k(token) LEFT JOIN ({COUNT.format(SPLIT)}) AS c ON k.token = c.token"),
    "token_classes": (lookup_kind, f"SELECT token, regexp_matches(token, '^[eyuioa]') AS vowel_start, regexp_matches(token, '^[mncptMNCPT]') AS final_consonant_start, CAST(strlen(token) AS BIGINT) AS bytes, length(token) AS chars FROM ({COUNT.format(SPLIT)})"),
    "syllable_parse": (lambda s, d: count.routed(documents(s, d)).select("cnt", *PARTS), f"SELECT cnt, {', '.join(PARTS)} FROM {PARSED}"),
    "syllable_fixture": (lambda s, d: _fix(s).select(*PARTS), f"SELECT {', '.join(PARTS)} FROM {FIX}"),
    "syllable_spelling": (lambda s, d: count.spelled(_fix(s).filter("can_be_vietnamese").select("token", "syll_id")).select("token", "syll_id", "text"), f"SELECT token, syll_id, text FROM {layers.sql(layers.sql(f'(SELECT token, syll_id FROM {FIX} WHERE can_be_vietnamese)', syllable.DECODE), syllable.SPELL)}"),
    "syllable_lexicon": (lambda s, d: count.lexicon(s), f"SELECT syll_id, text, am_dau, am_giua, am_cuoi, tone FROM {LEXICON}"),
    "syllable_features": (lambda s, d: layers.apply(count.lexicon(s), FEATURES).select(*_features), f"SELECT {', '.join(_features)} FROM {layers.sql(LEXICON, FEATURES)}"),
    "syllable_counts": (lambda s, d: count.syllables(documents(s, d)), f"SELECT syll_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM {PARSED} WHERE can_be_vietnamese GROUP BY syll_id"),
    "syllable_list": (lambda s, d: count.spelled(count.syllables(documents(s, d)).orderBy("syll_id").limit(20)).select("syll_id", "text", "cnt"), f"SELECT syll_id, text, cnt FROM {layers.sql(layers.sql(f'(SELECT syll_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM {PARSED} WHERE can_be_vietnamese GROUP BY syll_id ORDER BY syll_id LIMIT 20)', syllable.DECODE), syllable.SPELL)}"),
    "type_counts": (lambda s, d: count.types(documents(s, d)), f"SELECT token, cnt FROM {TYPES}"),
    "vocabulary_list": (lambda s, d: count.types(documents(s, d)).orderBy(F.desc("cnt"), "token").limit(300), TOP.format(f"SELECT * FROM {TYPES}", 300)),
    "token_route": (token_route, f"SELECT CASE WHEN can_be_vietnamese THEN 'syllable' WHEN strlen(token) <= 32 THEN 'token' ELSE 'too long' END AS kind, count(*) AS types, CAST(sum(cnt) AS BIGINT) AS tokens FROM {PARSED} GROUP BY 1"),
    "mapped_route": (lambda s, d: count.mapped(documents(s, d)), f"SELECT c.token, c.cnt, l.syll_id FROM ({COUNT.format(SPLIT)}) AS c LEFT JOIN {LEXICON} AS l ON c.token = l.text"),
    "lexicon_selfcheck": (selfcheck, f"SELECT a.syll_id AS id, a.text AS token, b.syll_id FROM {LEXICON} AS a JOIN {LEXICON} AS b ON a.text = b.text WHERE a.syll_id <> b.syll_id"),
    "lexicon_nine_bytes": (lambda s, d: count.lexicon(s).filter("octet_length(text) = 9").select("syll_id", "text"), f"SELECT syll_id, text FROM {LEXICON} WHERE strlen(text) = 9"),
    "bpe_pair_counts": (lambda s, d: bpe.pairs(bpe.vocabulary(count.types(documents(s, d)))), _pairs(VOCAB)),
    "bpe_best_pair": (lambda s, d: bpe.best(bpe.pairs(bpe.vocabulary(count.types(documents(s, d))))), f"{_pairs(VOCAB)} ORDER BY cnt DESC, \"left\", \"right\" LIMIT 1"),
    "bpe_learn": (learnt, None),
    "bpe_learn_first": (lambda s, d: learnt(s, d, FIRST), _learn(FIRST) + " SELECT rank, \"left\", \"right\", cnt, symbol, TRY(decode(unhex(symbol))) AS text FROM (SELECT *, substr(\"left\", 2, length(\"left\") - 2) || substr(\"right\", 2, length(\"right\") - 2) AS symbol FROM (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(FIRST)) + "))"),
    "bpe_vocabulary": (lambda s, d: bpe.learn(count.types(documents(s, d)), K)[1], None),
    "bpe_vocabulary_first": (lambda s, d: bpe.learn(count.types(documents(s, d)), FIRST)[1], _learn(FIRST) + f" SELECT token, cnt, sym FROM v{FIRST}"),
    "bpe_dropout": (lambda s, d: learnt(s, d, K, 40 / 65536), None),
    "lexicon_respelled": (respelled, f"SELECT id, token, CASE WHEN syll_id IS NOT NULL THEN text END AS again, syll_id FROM {layers.sql(layers.sql(AGAIN, syllable.DECODE), syllable.SPELL)} WHERE {OTHERWISE}"),
    "syllable_lookup": (syllable_lookup, f"SELECT k.syll_id, coalesce(c.cnt, 0) AS cnt FROM (VALUES {', '.join(f'(CAST({i} AS BIGINT))' for i in ASKED_IDS)}) AS k(syll_id) LEFT JOIN (SELECT syll_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM {PARSED} WHERE can_be_vietnamese GROUP BY syll_id) AS c ON k.syll_id = c.syll_id"),
    "bpe_pair_lookup": (pair_lookup, f"SELECT k.l AS \"left\", k.r AS \"right\", coalesce(c.cnt, 0) AS cnt FROM (VALUES {', '.join(map(str, ASKED_PAIRS))}) AS k(l, r) LEFT JOIN ({_pairs(VOCAB)}) AS c ON k.l = c.\"left\" AND k.r = c.\"right\""),
    "bpe_pair_stats": (lambda s, d: bpe.pairs(bpe.vocabulary(count.types(documents(s, d)))).agg(F.count("*").alias("pairs"), F.sum("cnt").alias("puts"), F.max("cnt").alias("most")), f"SELECT count(*) AS pairs, CAST(sum(cnt) AS BIGINT) AS puts, max(cnt) AS most FROM ({_pairs(VOCAB)})"),
    "bpe_encode": (encoded, None),
    "bpe_encode_first": (lambda s, d: encoded(s, d, FIRST), _encode(FIRST)),
    "byte_set": (lambda s, d: _alpha(s, d).selectExpr("token", f"CAST({in_set('token', 'aeiouyAEIOUY')} AS BIGINT) AS hits"), f"SELECT token, CAST({in_set('token', 'aeiouyAEIOUY')} AS BIGINT) AS hits FROM ({COUNT.format(SPLIT)})"),
    "many_files": (many_files, COUNT.format(f"{SPLIT} UNION ALL SELECT unnest(regexp_extract_all(text, '{ALPHA}')) AS token FROM conversations")),
    "scanner_lines": (scanned, SCANNED),
    "syllable_cases": (cases, CASES_SQL),
    "lexicon_sizes": (lambda s, d: count.lexicon(s).agg(F.count("*").alias("spellings"), F.countDistinct("syll_id").alias("syllables"), F.count_if(F.octet_length("text") == 9).alias("nine_bytes")), "SELECT CAST(27154 AS BIGINT) AS spellings, CAST(27112 AS BIGINT) AS syllables, CAST(50 AS BIGINT) AS nine_bytes"),
    "corpus_shuffled": (lambda s, d: shuffled(documents(s, d)), "SELECT translate(text, chr(10), ' ') AS text FROM documents"),
    "flagship": (flagship, f"SELECT syll_id, token, cnt FROM (SELECT syll_id, CASE WHEN syll_id IS NULL THEN token END AS token, CAST(sum(cnt) AS BIGINT) AS cnt FROM {PARSED} WHERE can_be_vietnamese OR strlen(token) <= 32 GROUP BY 1, 2) ORDER BY cnt DESC, syll_id NULLS FIRST, token LIMIT 300"),
}
_chars = f"(SELECT ch, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch)"
_table["char_decode"] = (char_decode, f"SELECT ch, cnt, base, tone, vowel, upper, bytes FROM {layers.sql(_chars, CHARS)}")
_table["tone_histogram"] = (lambda s, d: char_decode(s, d).groupBy("tone").agg(F.sum("cnt").alias("cnt")), f"SELECT tone, CAST(sum(cnt) AS BIGINT) AS cnt FROM {layers.sql(_chars, CHARS)} GROUP BY tone")
QUERIES = {k: f for k, (f, _) in _table.items()}
SQL = {k: q for k, (_, q) in _table.items() if q}
