"""Cleaning, redaction, rule filters and word statistics over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlens.functions import text as T
from counterlens.functions.numbers import fixed
from counterlens.operators import rules as R
from counterlens.queries.base import SQL_RECORDS, r9, records, table
from counterlens.queries.registry import query

L, Rb = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"          # word edges where there is no lookaround
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", "text", *cols)


def sql_collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


@query("p2_whitespace_collapse", f"SELECT doc_id, md5({sql_collapse('text')}) AS clean, length({sql_collapse('text')})::INTEGER AS n FROM documents")
def p2(spark, sf):
    c = T.collapse("text")
    return docs(spark, sf).select("doc_id", F.md5(c).alias("clean"), F.length(c).alias("n"))


@query("p3_paragraph_clean", f"""WITH u AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[\\t\\f\\r ]*\\n\\s*') AS p FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(p, lambda x: {sql_collapse('x')}), lambda x: x <> ''), chr(10) || chr(10))) AS clean FROM u""")
def p3(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_paragraphs("text")).alias("clean"))


SQL_EMAIL = r"([^\pL\pN_]|^)[\pL\pN_.+-]*[\pL\pN_]@[\pL\pN_-]+(\.[\pL\pN_-]+)+"


@query("p4_contact_redaction", r"""SELECT doc_id, len(regexp_extract_all(text, '[\pL\pN_][\pL\pN_.+-]*@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+'))::INTEGER AS emails FROM documents""")
def p4(spark, sf):
    red = T.redact_contacts("text")
    return docs(spark, sf).select("doc_id", (T.occurrences(red, F.lit("[email]")) - T.occurrences("text", F.lit("[email]"))).alias("emails"))


@query("p5_title_strip", f"""SELECT doc_id, md5(regexp_replace(text, '{L}(?:Mr|Mrs|Ms|Miss|Mx)\\.?\\s+([A-Z])', '\\1\\2', 'g')) AS clean FROM documents""")
def p5(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.strip_titles("text")).alias("clean"))


@query("p6_scrub")
def p6(spark, sf):
    d = docs(spark, sf).withColumn("text", F.concat(F.lit("Jane Doe is here. "), F.col("text")))
    return T.scrub(d, "text").select("doc_id", "body", "name_resolved")


def _sql_pronouns(e: str) -> str:
    for word, repl in T.PRONOUNS:
        for first, out in ((word[0].upper(), repl.capitalize()), (word[0], repl)):
            for _ in range(2):                         # neighbouring words share their edge
                e = f"regexp_replace({e}, '{L}{first}(?i:{word[1:]}){Rb}', '\\1{out}\\2', 'g')"
    return e


@query("p7_neutral_pronouns", f"SELECT doc_id, md5({_sql_pronouns('text')}) AS clean FROM documents")
def p7(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.neutral_pronouns("text")).alias("clean"))


def _sql_agreement(e: str) -> str:
    for have, want in T.AGREEMENT:
        h, w = have.replace("'", "''"), want.replace("'", "''")
        for _ in range(2):
            e = f"regexp_replace({e}, '{L}([tT]hey) {h}{Rb}', '\\1\\2 {w}\\3', 'g')"
    return f"regexp_replace({e}, '(^|[.!?]\\s+)the applicant{Rb}', '\\1The applicant\\2', 'g')"


@query("p8_agreement_repair", f"SELECT doc_id, md5({_sql_agreement(_sql_pronouns('text'))}) AS clean FROM documents")
def p8(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.repair_agreement(T.neutral_pronouns("text"))).alias("clean"))


@query("p9_display_names", """SELECT p_partkey, CASE WHEN lower(substr(replace(lower(p_type), '_', ' '), 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || replace(lower(p_type), '_', ' ') AS role FROM part""")
def p9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.with_article(F.lower("p_type")).alias("role"))


@query("p30_reading_ease", r"""SELECT doc_id, round(206.835 - 1.015::DOUBLE * (greatest(len(regexp_extract_all(text, '\S+')), 1)::DOUBLE / greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE)
  - 84.6::DOUBLE * (len(regexp_extract_all(text, '[aeiouyAEIOUY]+'))::DOUBLE / greatest(len(regexp_extract_all(text, '\S+')), 1)::DOUBLE), 6) AS flesch FROM documents""")
def p30(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.flesch("text"), 6).alias("flesch"))


@query("p31_word_tokens", """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS word FROM documents)
SELECT lang, word, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def p31(spark, sf):
    return docs(spark, sf, "lang").select("lang", F.explode(T.words("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("p32_document_length", f"WITH {SQL_RECORDS} SELECT record_id, n_words AS doc_tokens, length(text)::INTEGER AS chars FROM records")
def p32(spark, sf):
    return records(spark, sf).select("record_id", F.col("n_words").alias("doc_tokens"), F.length("text").alias("chars"))


@query("p33_character_shingles", """WITH b AS (SELECT item_id, lower(text) AS t FROM benchmark), s AS (SELECT DISTINCT item_id, substr(t, i::BIGINT, 3) AS g FROM b, range(1, 100000) r(i) WHERE i <= length(t) - 2)
SELECT item_id, count(*)::BIGINT AS n, count(DISTINCT substr(g, 1, 1))::BIGINT AS firsts FROM s GROUP BY item_id""")
def p33(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", F.explode(T.shingles("text", 3)).alias("g"))
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("g", 1, 1)).alias("firsts"))


@query("p21_conversation_format", """WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, arg_max('user: ' || text || chr(10) || chr(10) || 'assistant: ' || nt, turn) AS f FROM t WHERE role = 'user' AND nr = 'assistant' GROUP BY conv_id)
SELECT conv_id, f AS conversation FROM p""")
def p21(spark, sf):
    """The last user turn and the assistant turn after it. Turns meet on (conversation, turn + 1), so a long
    conversation is not sorted in one task."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("next"))
    a = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("response"))
    both = u.join(a, ["conv_id", "next"])
    return both.groupBy("conv_id").agg(F.max_by(T.conversation("prompt", "response"), "turn").alias("conversation"))


@query("p22_text_keys", """SELECT turn, conv_id, sha256('[4096,' || to_json([text])::VARCHAR || ']') AS text_key FROM conversations""")
def p22(spark, sf):
    from counterlens.functions.keyed import text_key
    c = table(spark, sf, "conversations")
    return c.select("turn", "conv_id", text_key(F.col("text"), 4096).alias("text_key"))


@query("p23_template_hash", """SELECT source, substr(sha256(string_agg(lang || ':' || n, '|' ORDER BY lang)), 1, 12) AS fingerprint FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def p23(spark, sf):
    n = docs(spark, sf, "source", "lang").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda s: F.concat_ws(":", s.lang, s.n.cast("string")))
    return n.groupBy("source").agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 12).alias("fingerprint"))


@query("p44_length_spread", r"""SELECT source, (max(length(text)) - min(length(text)))::INTEGER AS chars, (max(len(regexp_extract_all(text, '\S+'))) - min(len(regexp_extract_all(text, '\S+'))))::INTEGER AS words FROM documents GROUP BY source""")
def p44(spark, sf):
    w = T.word_count("text")
    return docs(spark, sf, "source").groupBy("source").agg((F.max(F.length("text")) - F.min(F.length("text"))).alias("chars"), (F.max(w) - F.min(w)).alias("words"))


@query("p37_number_format", """SELECT o_orderpriority AS name, CASE WHEN avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NULL THEN '--' ELSE printf('%+.3f', avg(o_totalprice) / 100000) END AS value,
  printf('%.1f', 100 * avg((o_orderstatus = 'F')::INT)) AS pct FROM orders GROUP BY 1""")
def p37(spark, sf):
    f = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.when(F.avg(F.when(f, F.col("o_totalprice"))).isNull(), "--").otherwise(fixed(F.avg("o_totalprice") / 100000, 3, sign=True)).alias("value"),
        fixed(100 * F.avg(f.cast("double")), 1).alias("pct"))


# ---- predicates ------------------------------------------------------------------------------------------------------
SQL_GENDERED = f"regexp_matches(text, '(?i){L}(?:{T.GENDERED_WORDS}){Rb}') OR regexp_matches(text, '{L}{T.GENDERED_TITLES}(\\.?\\s+[A-Z])')"


@query("f6_gendered_words", f"""SELECT lang, count(*)::BIGINT AS n, count(*) FILTER ({SQL_GENDERED})::BIGINT AS gendered,
  round(avg((regexp_matches(text, '(?i){L}(?:{T.TOPICAL_WORDS}){Rb}'))::INT), 9) AS topical_rate FROM documents GROUP BY lang""")
def f6(spark, sf):
    return docs(spark, sf, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.gendered("text")).alias("gendered"),
                                                       r9(F.avg(T.mentions("text", T.TOPICAL_WORDS).cast("double"))).alias("topical_rate"))


HIRING_SQL = {
    "mentions_year_before_2014": f"regexp_matches(text, '{L}(?:19\\d\\d|200\\d|201[0-3]){Rb}')",
    "mentions_more_than_8_years": f"len(list_filter(regexp_extract_all(text, '(?i){L}(\\d{{1,2}})\\+?\\s*(?:-\\s*)?(?:plus\\s+)?years?{Rb}', 2), lambda y: y::INT > 8)) > 0",
    "mentions_many_years_in_words": f"regexp_matches(text, '(?i){L}(?:nine|ten|eleven|twelve|fifteen|twenty|thirty|forty)([\\s-][\\pL\\pN_\\s-]{{0,10}})?[\\s-]years?{Rb}|{L}decades?{Rb}')",
    "mentions_retirement": f"regexp_matches(text, '(?i){L}retire(?:d|ment){Rb}')"}


def _report_sql(rules: dict[str, str], source: str) -> str:
    any_hit = " OR ".join(f"({e})" for e in rules.values())
    parts = [f"SELECT 'n_in' AS rule, count(*)::BIGINT AS n FROM {source}",
             f"SELECT 'n_out', count(*) FILTER (NOT ({any_hit}))::BIGINT FROM {source}"]
    parts += [f"SELECT '{k}', count(*) FILTER ({e})::BIGINT FROM {source}" for k, e in rules.items()]
    return " UNION ALL ".join(parts)


@query("f3_hiring_rules", _report_sql(HIRING_SQL, "documents"))
def f3(spark, sf):
    return R.rule_report(docs(spark, sf), R.hiring_rules("text"))


ESSAY_SQL = {"prompt_presupposes_a_pupil": "lang NOT IN ('en', 'fr')",
             **{n: f"regexp_matches(text, '(?i){L}(?:{p}){Rb}')" for n, p in R.PUPIL_CUES},
             "mentions_own_household_money": f"regexp_matches(text, '(?i){L}(?:my|our)\\s+(?:family|parents|mom|dad|household)[^\\pL\\pN_.][^.]{{0,39}}(?:poor|rich|wealthy|afford|money|income|broke|struggl)')",
             "ends_with_a_signoff": r"""coalesce(regexp_matches(last, '(?i)^[^\pL\pN_]*(?:sincerely|sincerly|regards|best regards|kind regards|respectfully|yours truly|yours sincerely|thank you|thanks|signed)($|[^\pL\pN_])|,\s*sincere?ly($|[^\pL\pN_])')
   OR (len(regexp_extract_all(last, '\S+')) <= 4 AND NOT regexp_matches(regexp_replace(last, '["'')”’\x{94}]+$', ''), '[.!?]$')), false)"""}
SQL_LAST = f"lastline AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{WS}+', ''), '{WS}+$', '')), lambda x: x <> '')[-1] AS last FROM documents)"


@query("f4_f5_essay_rules", f"WITH {SQL_LAST} " + _report_sql(ESSAY_SQL, "lastline"))
def f4(spark, sf):
    return R.rule_report(docs(spark, sf, "lang"), R.essay_rules("text", "lang", ["en", "fr"]))


@query("f5_signoff_endings", f"WITH {SQL_LAST} SELECT doc_id, {ESSAY_SQL['ends_with_a_signoff']} AS signoff FROM lastline")
def f5(spark, sf):
    return docs(spark, sf).select("doc_id", T.ends_with_signoff("text").alias("signoff"))


@query("f1_named_rule_filter", """WITH f AS (SELECT doc_id, lang <> 'en' AS a, length(text) < 300 AS b, length(text) > 6000 AS c FROM documents) SELECT doc_id FROM f WHERE NOT (a OR b OR c)""")
def f1(spark, sf):
    n = F.length("text")
    rules = [("not_english", F.col("lang") != "en"), ("too_short", n < 300), ("too_long", n > 6000)]
    return R.apply_rules(docs(spark, sf, "lang"), rules).select("doc_id")


@query("f8_length_window", f"""WITH c AS (SELECT doc_id, {sql_collapse('text')} AS body FROM documents) SELECT doc_id, length(body)::INTEGER AS n FROM c WHERE length(body) BETWEEN 300 AND 6000""")
def f8(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(T.collapse("text")).alias("n")).filter(F.col("n").between(300, 6000))


@query("f9_score_bands", r"""WITH s AS (SELECT event_id, event_type, try_cast(CASE WHEN event_id % 40 = 0 THEN 'n/a' ELSE regexp_extract(props, '\d+') END AS DOUBLE) AS score FROM events),
r AS (SELECT *, CASE WHEN score IS NULL THEN 'unparsable_score' WHEN score >= 70 THEN 'strong' WHEN score <= 30 THEN 'weak' ELSE 'middle_score' END AS band FROM s)
SELECT event_type, band, count(*)::BIGINT AS n, avg(score) AS mean FROM r GROUP BY ALL""")
def f9(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 40 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    score = F.expr("try_cast(raw as double)")
    band = (F.when(F.col("score").isNull(), "unparsable_score").when(F.col("score") >= 70, "strong")
            .when(F.col("score") <= 30, "weak").otherwise("middle_score"))
    return (e.select("event_type", raw.alias("raw")).withColumn("score", score).withColumn("band", band)
            .groupBy("event_type", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")))


@query("f10_first_drop_reason", f"""WITH r AS (SELECT lang, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'pool' WHEN length(text) NOT BETWEEN 300 AND 6000 THEN 'length' WHEN {SQL_GENDERED} THEN 'gendered_word' END AS reason FROM documents)
SELECT coalesce(reason, 'kept') AS reason, lang, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def f10(spark, sf):
    reasons = [("pool", F.col("source").isin("src0", "src1", "src2")), ("length", ~F.length("text").between(300, 6000)), ("gendered_word", T.gendered("text"))]
    d = docs(spark, sf, "lang", "source").withColumn("reason", R.first_reason(reasons))
    return R.reason_report(d, "reason", "lang")


@query("f14_length_guard", f"""WITH c AS (SELECT conv_id, max(len(regexp_extract_all(text, '\\S+'))) AS longest FROM conversations GROUP BY conv_id) SELECT conv_id, longest::INTEGER AS longest FROM c WHERE longest <= 120""")
def f14(spark, sf):
    """A conversation is usable only if all its texts fit: an aggregate and a filter, texts never shuffled."""
    c = table(spark, sf, "conversations").select("conv_id", T.word_count("text").alias("w"))
    return c.groupBy("conv_id").agg(F.max("w").alias("longest")).filter("longest <= 120")


@query("f16_paired_question_drop", """WITH q AS (SELECT l_orderkey // 2 AS question, l_orderkey, max(l_quantity) > 49 AS excluded FROM lineitem GROUP BY ALL), b AS (SELECT question FROM q GROUP BY question HAVING NOT bool_or(excluded))
SELECT l_orderkey, q.question FROM q JOIN b USING (question)""")
def f16(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") > 49).alias("excluded")).withColumn("question", F.expr("l_orderkey div 2"))
    keep = q.groupBy("question").agg(F.bool_or("excluded").alias("x")).filter("not x").select("question")
    return q.join(keep, "question", "left_semi").select("l_orderkey", "question")


@query("f17_stray_ids", """SELECT count(*) FILTER (l.doc_id IS NOT NULL)::BIGINT AS kept, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS outside_manifest, count(*) FILTER (l.doc_id IS NOT NULL AND l.quality = 0)::BIGINT AS ineligible FROM documents d LEFT JOIN labels l USING (doc_id)""")
def f17(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").agg(F.count_if(F.col("quality").isNotNull()).alias("kept"), F.count_if(F.col("quality").isNull()).alias("outside_manifest"),
                                             F.count_if(F.col("quality") == 0).alias("ineligible"))


SQL_RUNS = "', '".join(T.PLACE_BEFORE), "', '".join(T.PLACE_AFTER)


@query("f7_first_name_hits", f"""WITH names AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+'))) AS name FROM benchmark),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, w, coalesce(lag(w) OVER o, '') AS bef, coalesce(lead(w) OVER o, '') AS aft, coalesce(lag(w, 2) OVER o, '') AS prev, coalesce(lead(w, 2) OVER o, '') AS nxt FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos, w FROM t WHERE regexp_matches(w, '^[A-Z][A-Za-z]*[a-z][A-Za-z]*$') AND NOT regexp_matches(bef, '[\\pL\\pN_]$') AND NOT regexp_matches(aft, '^[\\pL\\pN_]') AND bef NOT LIKE '%-'
  AND NOT (regexp_matches(bef, '^\\.?\\s*$') AND lower(prev) IN ('{SQL_RUNS[0]}')) AND NOT (regexp_matches(aft, '^\\s+$') AND lower(nxt) IN ('{SQL_RUNS[1]}')))
SELECT doc_id, arg_min(w, pos) AS first_name FROM h WHERE lower(w) IN (SELECT name FROM names) GROUP BY doc_id""")
def f7(spark, sf):
    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))
    return R.first_name_hits(docs(spark, sf), "doc_id", "text", names)


@query("f13_vocabulary_lint", """WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS word FROM documents),
v AS (SELECT word FROM w GROUP BY word HAVING count(*) < (SELECT count(DISTINCT lang) FROM documents)),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS word FROM benchmark)
SELECT item_id, count(*)::BIGINT AS violations, min(word) AS first_word FROM b WHERE word IN (SELECT word FROM v) GROUP BY item_id""")
def f13(spark, sf):
    """Banned words = union over groups minus intersection over groups; texts that use one (also U4)."""
    w = docs(spark, sf, "lang").select("lang", F.explode(F.array_distinct(T.words("text"))).alias("word")).distinct()
    k = docs(spark, sf, "lang").agg(F.count_distinct("lang").alias("k"))
    banned = w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(k)).filter("n < k").select("word")
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.words("text"))).alias("word"))
    return b.join(banned, "word", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("violations"), F.min("word").alias("first_word"))


# ---- reports -----------------------------------------------------------------------------------------------------------
@query("a1_drop_counts", """SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (length(text) < 300)::BIGINT AS too_short, count(*) FILTER (length(text) > 6000)::BIGINT AS too_long,
  round(avg((length(text) BETWEEN 300 AND 6000)::INT), 4) AS keep_rate FROM documents GROUP BY lang""")
def a1(spark, sf):
    n = F.length("text")
    return docs(spark, sf, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(n < 300).alias("too_short"), F.count_if(n > 6000).alias("too_long"),
                                                       F.round(F.avg(n.between(300, 6000).cast("double")), 4).alias("keep_rate"))


@query("a2_group_mix", """WITH f AS (SELECT source, length(text) BETWEEN 300 AND 6000 AS a, length(text) BETWEEN 300 AND 6000 AND lang = 'en' AS u FROM documents),
c AS (SELECT source, count(*)::BIGINT AS loaded, count(*) FILTER (a)::BIGINT AS after_rules, count(*) FILTER (u)::BIGINT AS used FROM f GROUP BY source)
SELECT source, loaded, after_rules, used, round(after_rules / loaded, 4) AS keep_rate, round(loaded / sum(loaded) OVER (), 4) AS share_loaded, round(used / sum(used) OVER (), 4) AS share_used FROM c""")
def a2(spark, sf):
    ok = F.length("text").between(300, 6000)
    return R.stage_mix(docs(spark, sf, "source", "lang"), "source", ok, ok & (F.col("lang") == "en"))


@query("a3_label_leak", f"""WITH {SQL_RECORDS}, p AS (SELECT grp, count(*) FILTER (strong) AS y, count(*) FILTER (NOT strong) AS n FROM records GROUP BY 1)
SELECT round(sum(greatest(y, n)) / sum(y + n), 4) AS single_field_accuracy, min(round(y / (y + n), 3)) AS p_min, max(round(y / (y + n), 3)) AS p_max FROM p""")
def a3(spark, sf):
    return R.label_leak(records(spark, sf, text=False), "grp", "strong")


@query("a4_placeholder_tokens", f"""WITH {SQL_RECORDS}, t AS (SELECT strong, unnest(list_distinct(regexp_extract_all(text, '[#%*&]{{3}}'))) AS token FROM records)
SELECT token, count(*) FILTER (strong)::BIGINT AS strong, count(*) FILTER (NOT strong)::BIGINT AS weak FROM t GROUP BY token""")
def a4(spark, sf):
    return R.placeholder_report(records(spark, sf), "text", "strong", "[#%*&]{3}")


@query("a5_design_counts", """SELECT lang, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents GROUP BY lang""")
def a5(spark, sf):
    return docs(spark, sf, "lang", "source").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"),
                                                                 F.array_join(F.array_sort(F.collect_set("source")), ",").alias("names"))


# ---- positioned sentences -------------------------------------------------------------------------------------------------
@query("p15_sentence_boundaries")
def p15(spark, sf):
    """Rows only: the boundary rule needs look-behind; checked against a character loop in the tests."""
    b = T.sentence_boundaries("text")
    return docs(spark, sf).select("doc_id", F.size(b).alias("n"), F.try_element_at(b, F.lit(1)).alias("first"), F.try_element_at(b, F.lit(-1)).alias("last"))


@query("p16_insertion_points")
def p16(spark, sf):
    """The boundary nearest to the middle. A generator keeps the row or not: a filter would look for the boundaries once more."""
    mid = F.floor(F.length("text") / 2).cast("int")
    nearest = F.transform(F.array(mid), lambda m: F.array_min(F.transform(
        T.sentence_boundaries("text"), lambda x: F.struct(F.abs(x - m).alias("d"), x.alias("at"))))["at"])
    d = docs(spark, sf).select("doc_id", "text", F.explode(F.filter(nearest, lambda x: x.isNotNull())).alias("cut"))
    return d.select("doc_id", "cut", T.insert_at("text", F.lit(" It matters to me."), F.col("cut")).alias("text"))


# ---- sets -------------------------------------------------------------------------------------------------------------------
@query("u1_union_of_placements", """SELECT 'decision' AS placement, o_orderkey AS id, o_orderstatus AS response, NULL::VARCHAR AS chosen FROM orders
UNION ALL SELECT 'two_record', l_orderkey, NULL, l_returnflag FROM lineitem""")
def u1(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("decision").alias("placement"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("response"))
    b = table(spark, sf, "lineitem").select(F.lit("two_record").alias("placement"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("chosen"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_union_of_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def u2(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()


@query("u3_name_set_difference", """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents WHERE lang = 'fr')
SELECT word FROM w WHERE word NOT IN (SELECT word FROM d)""")
def u3(spark, sf):
    def vocab(df):
        return df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    return vocab(table(spark, sf, "benchmark")).join(vocab(docs(spark, sf, "lang").filter("lang = 'fr'")), "word", "left_anti")


@query("u5_overlap_emptiness", """SELECT lang, (SELECT count(*) FROM documents d2 JOIN labels l USING (doc_id) WHERE d2.lang = d.lang)::BIGINT AS shared FROM documents d GROUP BY lang""")
def u5(spark, sf):
    d = docs(spark, sf, "lang").select("doc_id", "lang")
    hit = d.join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return hit.groupBy("lang").agg(F.count("hit").alias("shared"))


@query("f15_sex_coded_names", """WITH n AS (SELECT p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'boy' ELSE 'girl' END AS sex, p_retailprice / 1000 AS percent, 1900 + p_size AS year FROM part),
s AS (SELECT name, sum(percent) FILTER (sex = 'boy') AS boy, sum(percent) FILTER (sex = 'girl') AS girl FROM n WHERE year >= 1910 GROUP BY name)
SELECT name, CASE WHEN coalesce(boy, 0) > coalesce(girl, 0) THEN 'boy' ELSE 'girl' END AS sex, round(greatest(coalesce(boy, 0), coalesce(girl, 0)) / (coalesce(boy, 0) + coalesce(girl, 0)), 9) AS share
FROM s WHERE greatest(coalesce(boy, 0), coalesce(girl, 0)) / (coalesce(boy, 0) + coalesce(girl, 0)) >= 0.55 AND coalesce(boy, 0) + coalesce(girl, 0) >= 2""")
def f15(spark, sf):
    from counterlens.sources.corpora import sex_coded_names
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "boy").otherwise("girl").alias("sex"),
                                        (F.col("p_retailprice") / 1000).alias("percent"), (1900 + F.col("p_size")).alias("year"))
    return sex_coded_names(p, first_year=1910, min_total=2.0, min_share=0.55).select("name", "sex", r9("share").alias("share"))
