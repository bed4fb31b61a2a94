"""Queries of the cleaning and parsing functions (T), over documents, pages, conversations and benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from postloom.functions import model_output
from postloom.functions import text as T
from postloom.plans.registry import query, quoted, table

#: Documents as messages: headers before and a signature after each text, so that every cleaning rule meets its case.
_HEAD = "From: a.b@example.com\nSubject: Re: [EXT] Fwd: Note\n2024-10-07 14:43 | From: x\n"
_MID = "\n> quoted   line!!!\n-----Original Message-----\nhttps://example.com/path\nwww.example.com\nSee www.a.org and c.d@example.org...... ok??\nLegal notice follows\n"
_TAIL = "\n\n\n\nKind regards,\nSome One\n"
_MAIL_SQL = f"({quoted(_HEAD)} || text || {quoted(_MID)} || text || {quoted(_TAIL)})"


def _mail():
    return F.concat(F.lit(_HEAD), F.col("text"), F.lit(_MID), F.col("text"), F.lit(_TAIL))


def _r(c: str, pattern: str, new: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(new)}, '{flags}')"


def _by_doc(select: str, source: str = _MAIL_SQL) -> str:
    return f"SELECT doc_id, {select.format(source)} AS value FROM documents"


def _simple(column):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", column(_mail()).alias("value"))

    return run


def _add(name: str, column, sql: str) -> None:
    f = _simple(column)
    f.__name__ = name
    query(sql)(f)


def _headers(c):
    return _r(c, "(?im)" + T.HEADER_LINE, "")


def _forward(c):
    return _r(c, "(?im)" + T.FORWARD_LINE, "")


def _unquote(c):
    return _r(c, "(?m)" + T.QUOTE_MARK, r"\1")


def _signature(c):
    tail = f"right({c}, {T.SIGNATURE_TAIL})"
    kept = _r(tail, "(?im)" + T.SIGNATURE_ON, "")
    head = f"left({c}, greatest(length({c}) - {T.SIGNATURE_TAIL}, 0))"
    return f"CASE WHEN length({c}) >= {T.SIGNATURE_LEAST} AND {kept} <> {tail} THEN {_r(f'{head} || {kept}', chr(92) + 's+' + chr(92) + 'z', '')} ELSE {c} END"


def _boilerplate(c):
    known = " OR ".join(f"contains(lower(b), {quoted(k)})" for k in T.BOILERPLATE)
    bare = _r("line", r"^\s+|\s+\z", "")
    test = f"""b <> '' AND (regexp_matches(b, {quoted(T.SOLE_URL)}) OR regexp_matches(b, {quoted(T.SOLE_WWW)}) OR {known}
      OR (length(b) > {T.BOILERPLATE_LENGTH} AND len(regexp_extract_all(b, {quoted(T.SEPARATOR_RUN)})) >= 2 AND NOT contains(b, '@')))"""
    return f"array_to_string(list_filter(string_split({c}, chr(10)), lambda line: NOT list_contains(list_transform([{bare}], lambda b: {test}), true)), chr(10))"


def _contacts(c):
    return _r(_r(_r(c, T.EMAIL, "[EMAIL_REDACTED]"), T.URL, "[URL_REDACTED]"), T.WWW, "[URL_REDACTED]")


def _rules(c, rules):
    return reduce(lambda x, rule: _r(x, *rule), rules, c)


_add("t01_strip_control_chars", lambda c: T.strip_control_chars(F.concat(c, F.lit("\x01\x7f"))), _by_doc(_r("{} || chr(1) || chr(127)".format(_MAIL_SQL), T.CONTROL_CHARS, "").replace("{", "{{").replace("}", "}}")))
for _name, _f, _s in (
    ("t03_header_lines", T.remove_header_lines, _headers),
    ("t04_signature", T.strip_signature, _signature),
    ("t05_forward_lines", T.remove_forward_lines, _forward),
    ("t06_quote_marks", T.remove_quote_marks, _unquote),
    ("t07_boilerplate_lines", T.drop_boilerplate_lines, _boilerplate),
    ("t08_redact_contacts", T.redact_contacts, _contacts),
    ("t09_punctuation", lambda c: T.collapse_white_space(T.collapse_punctuation(c)), lambda c: _rules(_rules(c, T.PUNCTUATION), T.WHITE_SPACE)),
):
    _add(_name, _f, f"SELECT doc_id, {_s('m')} AS value FROM (SELECT doc_id, {_MAIL_SQL} AS m FROM documents)")


def _steps() -> str:
    """The whole cleaning, one step a sub-select."""
    sql = f"SELECT doc_id, {_MAIL_SQL} AS m FROM documents"
    for step in (_headers, _signature, _forward, _unquote, _boilerplate, _contacts, lambda c: _rules(c, T.PUNCTUATION), lambda c: _rules(c, T.WHITE_SPACE), lambda c: _r(c, r"^\s+|\s+\z", "")):
        sql = f"SELECT doc_id, {step('m')} AS m FROM ({sql})"
    return f"SELECT doc_id, m AS value FROM ({sql})"


_add("t02_clean_email_text", T.clean_email_text, _steps())


@query(
    f"""SELECT doc_id, {_r("'Re: FW: [EXT] ' || left(text, 40) || '  x'", T.SUBJECT_PREFIX, "")} AS stripped,
    lower(trim({_r(_r(_r("'Re: FW: [EXT] ' || left(text, 40) || '  x'", T.SUBJECT_PREFIX, ""), chr(92) + "[.*?" + chr(92) + "]", ""), chr(92) + "s+", " ")})) AS subject FROM documents"""
)
def t10_normalize_subject(spark, sf_dir):
    raw = F.concat(F.lit("Re: FW: [EXT] "), F.left("text", F.lit(40)), F.lit("  x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(raw, T.SUBJECT_PREFIX, "").alias("stripped"), T.normalize_subject(raw).alias("subject"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'folder') AS subject FROM documents")
def t11_resolve_subject(spark, sf_dir):
    smart = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.first_filled(smart, F.col("source"), F.lit("folder")).alias("subject"))


@query(
    f"""SELECT page_id, trim({_r(_r(_r(_r(_r("html", "(?is)<script[^>]*>.*?</script>", " "), "(?is)<style[^>]*>.*?</style>", " "), "(?is)<noscript[^>]*>.*?</noscript>", " "), "(?s)<[^>]+>", " "), chr(92) + "s+", " ")}) AS text FROM pages"""
)
def t25_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def _distinct_sql(values: str) -> str:
    """Values of a list without those that equal an earlier one but for case."""
    return f"list_filter({values}, lambda x, i: list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = i)"


@query(
    f"""WITH m AS (SELECT turn, conv_id, text || ' see report_{{a}}.pdf or "My File" and Attached: draft notes, Report_A.PDF' AS t FROM conversations),
c AS (SELECT conv_id, turn,
  list_concat(list_concat(regexp_extract_all(t, {quoted(T.DOCUMENT_NAME)}, 1),
    list_filter(list_transform(regexp_extract_all(t, {quoted(T.QUOTED_NAME)}, 1), lambda x: {_r("x", r"^[ \t\n]+|[ \t\n]+$", "")}), lambda x: contains(x, '_') OR regexp_matches(x, '[A-Z]') OR contains(x, '.'))),
    list_filter(list_transform(regexp_extract_all(t, {quoted(T.ATTACHED_NAME)}, 1), lambda x: {_r("x", r"^[ \t\n]+|[ \t\n]+$", "")}), lambda x: length(x) > 2)) AS v FROM m)
SELECT conv_id, turn, array_to_string({_distinct_sql("v")}, '|') AS mentions FROM c"""
)
def t26_document_mentions(spark, sf_dir):
    text = F.concat("text", F.lit(' see report_{a}.pdf or "My File" and Attached: draft notes, Report_A.PDF'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.document_mentions(text), "|").alias("mentions"))


@query(
    f"""WITH c AS (SELECT item_id, list_concat(list_concat(regexp_extract_all(t, {quoted(T.ENTITY_QUOTED)}, 1), regexp_extract_all(t, {quoted(T.ENTITY_PHRASE)}, 1)), regexp_extract_all(t, {quoted(T.ENTITY_WORD)}, 1)) AS v
  FROM (SELECT item_id, {_r("text", "[^" + chr(92) + "x00-" + chr(92) + "x7F]", "_")} AS t FROM benchmark)),
b AS (SELECT item_id, list_filter(list_transform(v, lambda x: {_r("x", r"^[\s.,!?;:]+|[\s.,!?;:]+$", "")}), lambda x: x <> '' AND NOT lower(x) IN ({", ".join(map(quoted, T.ENTITY_STOP_WORDS))})) AS v FROM c)
SELECT item_id, array_to_string(list_transform(list_sort(list_transform({_distinct_sql("v")}, lambda x: {{'k': lower(x), 'v': x}})), lambda x: x.v), '|') AS entities FROM b"""
)
def t27_entity_mentions(spark, sf_dir):
    # word ends are Unicode's in one dialect and ASCII's in the other, so that letters beyond ASCII are made word characters
    text = F.regexp_replace("text", "[^\\x00-\\x7F]", "_")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.entity_mentions(text), "|").alias("entities"))


@query(f"""SELECT doc_id, {_r("left(text, 60) || '50%_a' || chr(92)", chr(92) * 0 + "([" + chr(92) * 2 + "%_])", chr(92) * 2 + chr(92) + "1")} AS pattern FROM documents""")
def t28_escape_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_like(F.concat(F.left("text", F.lit(60)), F.lit("50%_a\\"))).alias("pattern"))


@query(
    """WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS v FROM nation GROUP BY 1)
SELECT n_regionkey, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' +' || (len(v) - 3) || ' more' ELSE '' END AS preview FROM g"""
)
def t29_participants_preview(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    return names.select("n_regionkey", T.preview(F.col("v")).alias("preview"))


@query(
    """SELECT doc_id, concat_ws(' | ', 'From: ' || nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN 'Date: 2024-01-01' END, 'Subject: ' || nullif(lang, ''), 'Content: ' || nullif(text, '')) AS line FROM documents"""
)
def t30_rerank_text(spark, sf_dir):
    date = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01"))
    return table(spark, sf_dir, "documents").select("doc_id", T.rerank_text(F.col("source"), date, F.col("lang"), F.col("text")).alias("line"))


_CASES = ["please draft an email to ann", "from john smith", "urgent: reply to bob by eod", "what does the policy say", "find the email about last week", "follow-up on earlier terms"]
_CASES_SQL = "CASE turn % 6 " + " ".join(f"WHEN {k} THEN {quoted(c)}" for k, c in enumerate(_CASES)) + " END || ' ' || left(text, 80)"


@query(
    f"""WITH q AS (SELECT conv_id, turn, {_CASES_SQL} AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, {quoted(T.any_of(T.DRAFTING))}) THEN 'drafting' WHEN regexp_matches(q, {quoted(T.any_of(T.NAVIGATIONAL))}) THEN 'navigational' ELSE 'semantic' END AS kind,
  concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(q, {quoted(T.any_of(p))}) THEN '{n}' END" for n, p in T.QUERY_FLAGS.items())}) AS flags FROM q"""
)
def t32_classify_query(spark, sf_dir):
    case = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("turn") % 6 + 1).cast("int"))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(case, F.lit(" "), F.left("text", F.lit(80))).alias("q"))
    return q.select("conv_id", "turn", T.query_type(F.col("q")).alias("kind"), F.array_join(T.query_flags(F.col("q")), ",").alias("flags"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id END AS id, CASE WHEN turn % 4 = 3 THEN NULL ELSE text || ' {x}' END AS said FROM conversations")
def t31_json_object(spark, sf_dir):
    """Objects in answers: bare, fenced after a thought, among prose, and none."""
    c = table(spark, sf_dir, "conversations")
    own = F.to_json(F.struct("conv_id", F.concat("text", F.lit(" {x}")).alias("said")))
    k = F.col("turn") % 4
    answer = (
        F.when(k == 0, own)
        .when(k == 1, F.concat(F.lit('<think>{"no": 1}</think> Well:\n```json\n'), own, F.lit("\n```\nDone {")))
        .when(k == 2, F.concat(F.lit("Here is the data: "), own, F.lit(" ... {extra} text.")))
        .otherwise(F.concat(F.lit("I have { none: "), F.col("conv_id").cast("string")))
    )
    found = c.select("conv_id", "turn", F.from_json(model_output.json_object(answer), "conv_id bigint, said string").alias("o"))
    return found.select("conv_id", "turn", F.col("o.conv_id").alias("id"), "o.said")
