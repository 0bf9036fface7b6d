"""Registered document retrieval and conversation-log annotation."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hearthcheck.demo.registry import query
from hearthcheck.demo.views import base_table, view
from hearthcheck.operators import chatlog as L
from hearthcheck.operators import retrieval as T
from hearthcheck.plans.catalog import TableSet
from hearthcheck.session import shared_folder
from hearthcheck.sources import tables as ST

# ---------------------------------------------------------------------- documents

# The documents with windows line ends, trailing blanks and bursts of empty lines put in.
MESSY = "concat('  ', replace(replace(text, '. ', ' .  \t\r\n'), ', ', '\n\n\n\n,'), ' \n ')"
SQL_MESSY = MESSY.replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
SPARK_MESSY = MESSY.replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")


@query(
    "clean_text",
    f"""
    select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace({SQL_MESSY}, chr(13) || chr(10), chr(10)),
      '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+\\z', '', 'g')) as digest
    from documents
    """,
)
def clean_text(spark, folder):
    messy = base_table(spark, folder, "documents").selectExpr("doc_id", f"{SPARK_MESSY} as text")
    return messy.select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query(
    "document_header",
    r"""
    select doc_id, md5('Document: ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(text,
      '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+\z', '', 'g')) as digest from documents
    """,
)
def document_header(spark, folder):
    documents = base_table(spark, folder, "documents")
    headed = documents.withColumn("headed", T.with_header(F.col("source"), F.col("text")))
    return headed.select("doc_id", F.md5("headed").alias("digest"))


PASSAGES = """
  bodies as (select doc_id as source, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) as blocks
    from documents where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
  kept as (select source, trim(blocks[1], ' ' || chr(9) || chr(13)) as first_line,
    case when len(blocks) > 1 then blocks[2:] else blocks end as kept from bodies),
  cut as (select source, first_line, unnest(kept) as block, generate_subscripts(kept, 1) - 1 as passage_no from kept),
  passages as (select source, cast(passage_no as bigint) as passage_no,
    '[' || source || '] ' || first_line || ' — ' || trim(block, ' ' || chr(9) || chr(13)) as text
    from cut where trim(block, ' ' || chr(9) || chr(13)) <> '')
"""


def _passages(spark, folder):
    return T.passages(base_table(spark, folder, "documents"), "doc_id", "text", separator="\n")


@query("passages", f"with {PASSAGES} select source, passage_no, md5(text) as digest from passages")
def passages(spark, folder):
    """Documents have single line breaks, so a block is a line."""
    return _passages(spark, folder).select("source", "passage_no", F.md5("text").alias("digest"))


@query(
    "passages_blank_lines",
    r"""
    with bodies as (select doc_id as source, string_split_regex(trim(replace(text, chr(10), chr(10) || ' ' || chr(10)), chr(10) || ' '),
        '\n\s*\n') as blocks from documents where length(trim(text, chr(10) || ' ')) > 0),
      cut as (select source, trim(blocks[1], chr(10) || ' ') as first_line, unnest(case when len(blocks) > 1 then blocks[2:] else blocks end) as block,
        generate_subscripts(case when len(blocks) > 1 then blocks[2:] else blocks end, 1) - 1 as passage_no from bodies)
    select source, cast(passage_no as bigint) as passage_no,
      md5('[' || source || '] ' || first_line || ' — ' || trim(block, chr(10) || ' ')) as digest
    from cut where trim(block, chr(10) || ' ') <> ''
    """,
)
def passages_blank_lines(spark, folder):
    """Blocks are parted by blank lines, some of them with blanks in."""
    spaced = base_table(spark, folder, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return T.passages(spaced, "doc_id", "text").select("source", "passage_no", F.md5("text").alias("digest"))


TERMS = """
  words as (select {ids}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from {source}),
  counts as (select {ids}, term, count(*) as tf from (
    select {ids}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words) q
    group by all)
"""


def terms_sql(prefix: str, ids: str, source: str) -> str:
    text = TERMS.format(ids=ids, source=source)
    return text.replace("words as", f"{prefix}_words as").replace("from words", f"from {prefix}_words").replace("counts as", f"{prefix}_counts as")


IDF = f"""
  {terms_sql("p", "source, passage_no", "passages")},
  size as (select count(*) as n from passages),
  idf as (select term, df, ln((1.0 + n) / (1.0 + df)) + 1 as idf from (
    select term, count(*) as df from p_counts group by term) f, size where df <= 0.9 * n)
"""
INDEX = f"""
  {IDF},
  weighted as (select source, passage_no, c.term, tf * idf as w from p_counts c join idf on idf.term = c.term),
  postings as (select source, passage_no, term, w / sqrt(sum(w * w) over (partition by source, passage_no)) as weight from weighted)
"""


def _index(spark, folder) -> T.PassageIndex:
    """The index of the documents, written to the shared folder under what it is built from: the files, their times
    and sizes, and the settings. Changed documents get an index of their own. Passages are cut from the documents again
    where they are used, not written a second time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/documents.parquet")
    state = files.select(F.xxhash64("path", "modificationTime", "length").alias("h")).agg(F.count("*"), F.bit_xor("h")).first()
    settings = f"{spark.sparkContext.applicationId} {folder} {tuple(state)} {T.WORD} {T.P.MAX_DOCUMENT_SHARE}"
    name = hashlib.md5(settings.encode()).hexdigest()
    path, cut = f"{shared_folder(spark)}/passage-index-{name}", _passages(spark, folder)
    try:
        return T.PassageIndex.load(spark, path, ("source", "passage_no"), cut)
    except AnalysisException:
        return T.build_index(cut).save(path, copy=False)


@query(
    "tfidf_terms",
    f"with {PASSAGES}, {IDF} select df, count(*) as n_terms, round(min(idf), 6) as idf, min(term) as first_term from idf group by df",
)
def tfidf_terms(spark, folder):
    index = T.build_index(_passages(spark, folder))
    return index.idf.groupBy("df").agg(
        F.count("*").alias("n_terms"), F.round(F.min("idf"), 6).alias("idf"), F.min("term").alias("first_term")
    )


@query(
    "tfidf_weights",
    f"with {PASSAGES}, {INDEX} select source, count(*) as n, round(sum(weight), 4) as total, round(max(weight), 6) as heaviest from postings group by source",
)
def tfidf_weights(spark, folder):
    index = T.build_index(_passages(spark, folder))
    return index.postings.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 6).alias("heaviest")
    )


def ranked_sql(questions: str, boost: str = "1.0", name: str = "q", k: int = 5) -> str:
    """CTEs ranking passages for ``questions`` (query_id, text)."""
    return f"""
      {name}_questions as ({questions}),
      {terms_sql(name, "query_id", f"{name}_questions")},
      {name}_weighted as (select query_id, c.term, tf * idf as w from {name}_counts c join idf on idf.term = c.term),
      {name}_vectors as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as weight from {name}_weighted),
      {name}_scores as (select query_id, source, passage_no, round(sum(v.weight * p.weight) * {boost}, 6) as score
        from {name}_vectors v join postings p on p.term = v.term group by query_id, source, passage_no),
      {name}_ranked as (select * from (
        select *, row_number() over (partition by query_id order by score desc, source, passage_no) as rank
        from {name}_scores where score > 0) r where rank <= {k})
    """


QUESTIONS = "select item_id as query_id, text from benchmark"


@query("tfidf_topk", f"with {PASSAGES}, {INDEX}, {ranked_sql(QUESTIONS)} select query_id, source, passage_no, score, rank::integer as rank from q_ranked")
def tfidf_topk(spark, folder):
    index = _index(spark, folder)
    return T.rank_passages(index, base_table(spark, folder, "benchmark"), "item_id", "text")


BOOSTED = list(range(0, 40))


@query(
    "tfidf_boosted",
    f"with {PASSAGES}, {INDEX}, {ranked_sql(QUESTIONS, 'case when source < 40 then 1.5 else 1.0 end', k=3)} "
    "select query_id, source, passage_no, score, rank::integer as rank from q_ranked",
)
def tfidf_boosted(spark, folder):
    index = _index(spark, folder)
    return T.rank_passages(index, base_table(spark, folder, "benchmark"), "item_id", "text", k=3, boosted=BOOSTED)


VAGUE = "select item_id as query_id, regexp_replace(text, '[A-Za-z]{4,}', 'the', 'g') as text from benchmark"


@query(
    "tfidf_second_phrasing",
    f"""
    with {PASSAGES}, {INDEX}, {ranked_sql(VAGUE, name="a")}, {ranked_sql(QUESTIONS, name="b")},
      chosen as (select b.query_id, coalesce(max(a.score), 0) as top1, max(b.score) as top2
        from (select query_id, max(score) as score from b_ranked group by 1) b
        left join (select query_id, max(score) as score from a_ranked group by 1) a on a.query_id = b.query_id group by b.query_id)
    select 1 as phrasing, a.query_id, source, passage_no, score, rank::integer as rank from a_ranked a
      left join chosen c on c.query_id = a.query_id where not coalesce(top1 < 0.5 and top2 > top1, false)
    union all
    select 2, b.query_id, source, passage_no, score, rank::integer from b_ranked b join chosen c on c.query_id = b.query_id
      where top1 < 0.5 and top2 > top1
    """,
)
def tfidf_second_phrasing(spark, folder):
    """Questions with their longer words worn down, and the text as second phrasing; weak means below 0.5 here."""
    index = _index(spark, folder)
    questions = base_table(spark, folder, "benchmark").withColumn("short", F.regexp_replace("text", "[A-Za-z]{4,}", "the"))
    best = T.best_phrasing(index, questions, "item_id", "short", "text", weak=0.5)
    return best.select("phrasing", "query_id", "source", "passage_no", "score", "rank")


@query(
    "context_per_query",
    f"""
    with {PASSAGES}, {INDEX}, {ranked_sql(QUESTIONS)}
    select query_id, string_agg('- ' || p.text, chr(10) order by rank) as context
    from q_ranked r join passages p on p.source = r.source and p.passage_no = r.passage_no group by query_id
    """,
)
def context_per_query(spark, folder):
    index = _index(spark, folder)
    ranked = T.rank_passages(index, base_table(spark, folder, "benchmark"), "item_id", "text")
    return T.contexts(index, ranked)


@query(
    "documents_to_convert",
    """
    select doc_id, source from documents
    where (doc_id % 3 = 0 or doc_id % 7 > doc_id % 5) and length(trim(text)) > 0
    """,
)
def documents_to_convert(spark, folder):
    """Every third document was never converted; the others were at a time that may be too early."""
    documents = base_table(spark, folder, "documents")
    start = F.lit("2024-01-01").cast("date")
    sources = documents.select(
        F.col("doc_id").cast("string").alias("stem"),
        F.date_add(start, (F.col("doc_id") % 7).cast("int")).alias("modified"),
        "text", "doc_id", "source",
    )
    converted = documents.where("doc_id % 3 <> 0").select(
        F.col("doc_id").cast("string").alias("stem"),
        F.date_add(start, (F.col("doc_id") % 5).cast("int")).alias("modified"),
    )
    return ST.documents_to_convert(sources, converted).select("doc_id", "source")


@query("index_staleness", "select true as stale, max(ts)::varchar as newest from events")
def index_staleness(spark, folder):
    files = base_table(spark, folder, "events").select(F.col("ts").alias("modified"))
    return ST.is_index_stale(files, "2024-01-01 00:00:00").withColumn("newest", F.col("newest").cast("string"))


# ---------------------------------------------------------------------- conversations

# What is appended to each turn of the log, by (conversation + turn) modulo the length of the list.
PHRASES = (
    "audit complet de la base",
    "répartition de gender dans fneweducation",
    "les doublons de individid",
    "qui est dans education mais pas dans presences",
    "et vice versa, il faut analyser directement",
    "fusionne education et telephones",
    "quelle relation entre education et presence",
    "tableau croisé de gender et ethnic_gp",
    "corrélation entre weight et height",
    "échantillon de 25 lignes de fnewdeath",
    "recherche l'individu 1024",
    "bilan du terrain, objectif 20 000 ménages, en excluant les agents 12, 45 et 67",
    "qualité des enquêteurs",
    "combien de tables sont disponibles",
    "historique des actualisations",
    "analyse multivariée de trois colonnes",
    "cohérence dans les individus",
    "les individus en général",
    "fais le calcul",
    "des décès dans presences ?",
    "telephone et education_level",
)
N_PHRASES = len(PHRASES)
CASES = " ".join(
    "when {i} then '{p}'".format(i=i, p=p.replace("'", "''")) for i, p in enumerate(PHRASES)
)
TURNS = f"turns as (select conv_id, turn, role, text || ' ' || case (conv_id + turn) % {N_PHRASES} {CASES} end as text from conversations)"


def _turns(spark, folder):
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    picked = F.get(phrases, ((F.col("conv_id") + F.col("turn")) % N_PHRASES).cast("int"))
    return base_table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", F.lit(" "), picked).alias("text")
    )


CHAT_TABLES = {
    "individus": "individuals",
    "FNewPresences": "presences",
    "FNewEducation": "education",
    "FNewDeath": "deaths",
    "FNewTelephone": "telephones",
}


def _chat_tables(spark, folder) -> TableSet:
    return TableSet({n: view(spark, folder, v) for n, v in CHAT_TABLES.items()})


FOLDED = "strip_accents(lower(text))"
MENTIONS = {
    "individus": f"(contains({FOLDED}, 'individus'))",
    "FNewPresences": f"(contains({FOLDED}, 'fnewpresences') or regexp_matches({FOLDED}, '\\b(fnewpresences|presences|presence)\\b'))",
    "FNewEducation": f"(contains({FOLDED}, 'fneweducation') or regexp_matches({FOLDED}, '\\b(fneweducation|educations|education)\\b'))",
    "FNewDeath": f"(contains({FOLDED}, 'fnewdeath') or regexp_matches({FOLDED}, '\\b(fnewdeath|deaths|death)\\b'))",
    "FNewTelephone": f"(contains({FOLDED}, 'fnewtelephone') or regexp_matches({FOLDED}, '\\b(fnewtelephone|telephones|telephone)\\b'))",
}


def listed(tests: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {t} then '{n}' end" for n, t in tests.items()) + "], lambda x: x is not null), ',')"


@query("mention_tags", f"with {TURNS} select conv_id, turn, {listed(MENTIONS)} as mentioned from turns")
def mention_tags(spark, folder):
    found = L.mentioned_tables(F.col("text"), _chat_tables(spark, folder))
    return _turns(spark, folder).select("conv_id", "turn", F.array_join(found, ",").alias("mentioned"))


@query(
    "mention_counts",
    f"with {TURNS} " + " union all ".join(
        f"select '{n}' as table_name, count(*) as n_turns from turns where {t} having count(*) > 0" for n, t in MENTIONS.items()
    ),
)
def mention_counts(spark, folder):
    counts = L.mention_counts(_turns(spark, folder), _chat_tables(spark, folder))
    return counts.withColumnRenamed("table", "table_name")


ANCHORED = "\\b(dans|table|base|fiche|feuille|onglet)\\s+(la\\s+|le\\s+|les\\s+|l[''’]\\s*|de\\s+la\\s+|des\\s+)?(individus|individu)\\b"


@query(
    "mention_ambiguous_alias",
    f"""
    with {TURNS} select conv_id, turn,
      (contains({FOLDED}, 'fnew_individus') or regexp_matches({FOLDED}, '\\b(fnew_individus)\\b')
        or regexp_matches({FOLDED}, '{ANCHORED}')) as mentioned from turns
    """,
)
def mention_ambiguous_alias(spark, folder):
    """A table spoken of with a word everybody uses counts only after an anchor word."""
    test = L.mentions_table(L.S.folded(F.col("text")), "fnew_individus")
    return _turns(spark, folder).select("conv_id", "turn", test.alias("mentioned"))


COLUMN_NAMES = (
    "individid", "socialgpid", "gender", "ethnic_gp", "birth_date", "fatherid", "motherid", "entry_date", "eventid", "menageid",
    "field_wrkr", "sleep_lastnight", "arrive_date", "depart_date", "education_level", "evtdate", "diedinhs", "gonetohs", "NumTelephone",
)
HOLDERS = {
    "individus": COLUMN_NAMES[:8],
    "FNewPresences": ("eventid", "individid", "menageid", "field_wrkr", "entry_date", "sleep_lastnight", "arrive_date", "depart_date"),
    "FNewEducation": ("individid", "socialgpid", "education_level"),
    "FNewDeath": ("eventid", "individid", "field_wrkr", "evtdate", "diedinhs", "gonetohs"),
    "FNewTelephone": ("individid", "NumTelephone"),
}


def has(column: str) -> str:
    return f"contains(lower(text), '{column.lower()}')"


ANY_COLUMN = {t: "(" + " or ".join(has(c) for c in columns) + ")" for t, columns in HOLDERS.items()}
ALL_COLUMNS = {
    t: "((" + " or ".join(has(c) for c in COLUMN_NAMES) + ") and not (" + " or ".join(has(c) for c in COLUMN_NAMES if c not in columns) + "))"
    for t, columns in HOLDERS.items()
}


@query(
    "mention_columns",
    f"""
    with {TURNS} select conv_id, turn, {listed({c: has(c) for c in COLUMN_NAMES})} as columns,
      {listed(ANY_COLUMN)} as holding_any, {listed(ALL_COLUMNS)} as holding_all from turns
    """,
)
def mention_columns(spark, folder):
    tables = _chat_tables(spark, folder)
    turns = _turns(spark, folder).withColumn("c", L.mentioned_columns(F.col("text"), tables))
    return turns.select(
        "conv_id",
        "turn",
        F.array_join("c", ",").alias("columns"),
        F.array_join(L.tables_holding_any(F.col("c"), tables), ",").alias("holding_any"),
        F.array_join(L.tables_holding_all(F.col("c"), tables), ",").alias("holding_all"),
    )


def any_sql(words, whole: bool = False) -> str:
    if whole:
        return f"regexp_matches({FOLDED}, '\\b({'|'.join(sorted(words, key=len, reverse=True))})\\b')"
    return "(" + " or ".join("contains({}, '{}')".format(FOLDED, w.replace("'", "''")) for w in words) + ")"


def intent_sql(again: bool = False) -> str:
    def after(what: str) -> str:
        return f" or ({any_sql(L.DO_IT_WORDS)} and past_{what})" if again else ""

    rules = (
        ("list_tables", f"{any_sql(L.LIST_WORDS)} or ({any_sql(L.TABLE_WORDS)} and {any_sql(L.LOADING_WORDS)})"),
        ("audit", any_sql(L.AUDIT_WORDS)),
        ("status_overlap", f"{any_sql(L.DEATH_WORDS)} and coalesce(meant <> 'FNewDeath', false)" if again else "false"),
        ("load_history", any_sql(L.HISTORY_WORDS)),
        ("search_identifier", any_sql(L.SEARCH_WORDS)),
        ("field_performance", f"{any_sql(L.FIELD_WORDS)} and {any_sql(L.REPORT_WORDS)}"),
        ("difference", any_sql(L.DIFFERENCE_WORDS) + after("difference")),
        ("fusion", any_sql(L.FUSION_WORDS) + after("fusion")),
        ("relation", any_sql(L.RELATION_WORDS, True) + after("relation")),
        ("agent_quality", f"{any_sql(L.AGENT_WORDS)} and {any_sql(L.AGENT_QUALITY_WORDS)}"),
        ("crosstab", any_sql(L.CROSSTAB_WORDS, True)),
        ("correlation", any_sql(L.CORRELATION_WORDS, True)),
        ("multiway", any_sql(L.MULTIWAY_WORDS, True)),
        ("duplicates", any_sql(L.DUPLICATE_WORDS)),
        ("coherence", any_sql(L.COHERENCE_WORDS)),
        ("sample", any_sql(L.SAMPLE_WORDS)),
        ("frequency", any_sql(L.FREQUENCY_WORDS)),
    )
    return "case " + " ".join(f"when {test} then '{name}'" for name, test in rules) + " end"


@query("intent_rules", f"with {TURNS} select conv_id, turn, {intent_sql()} as intent from turns")
def intent_rules(spark, folder):
    turns = _turns(spark, folder)
    return turns.select("conv_id", "turn", L.intent(L.S.folded(F.col("text"))).alias("intent"))


@query(
    "turn_parameters",
    f"""
    with {TURNS} select conv_id, turn,
      coalesce(try_cast(regexp_replace(regexp_extract({FOLDED}, 'objectif\\D{{0,15}}?(\\d[\\d\\s.,]*)', 1), '\\D', '', 'g') as bigint), 17000) as goal,
      coalesce(nullif(regexp_extract(text, '\\b(\\d+)\\b', 1), ''),
        regexp_extract_all(text, '[A-Za-z0-9_\\-]{{3,}}')[-1]) as identifier,
      coalesce(try_cast(regexp_extract({FOLDED}, '\\d+', 0) as integer), 100) as sample_size,
      case when contains(text, 'en excluant les agents') then '12,45,67' end as excluded,
      {any_sql(L.BOTH_WAYS_WORDS)} as both_ways,
      {listed({label: any_sql(words) for label, words in L.CATEGORY_WORDS})} as categories
    from turns
    """,
)
def turn_parameters(spark, folder):
    text = F.col("text")
    folded = L.S.folded(text)
    return _turns(spark, folder).select(
        "conv_id",
        "turn",
        L.goal(folded).alias("goal"),
        L.identifier(text).alias("identifier"),
        L.sample_size(folded).alias("sample_size"),
        F.array_join(L.excluded_agents(text), ",").alias("excluded"),
        L.contains_any(folded, L.BOTH_WAYS_WORDS).alias("both_ways"),
        F.array_join(L.asked_categories(folded), ",").alias("categories"),
    )


NAMED = {n: f"contains(lower(text), '{n.lower()}')" for n in CHAT_TABLES}
SPEAKING = {
    "difference": any_sql(L.DIFFERENCE_WORDS),
    "fusion": any_sql(L.FUSION_WORDS),
    "relation": any_sql(L.RELATION_WORDS, True),
}
ALIASES = {
    "individus": "individus|individu", "FNewPresences": "fnewpresences|presences|presence",
    "FNewEducation": "fneweducation|educations|education", "FNewDeath": "fnewdeath|deaths|death",
    "FNewTelephone": "fnewtelephone|telephones|telephone",
}
OWNERS = {t: "(" + " or ".join(f"contains({FOLDED}, '{c.lower()}')" for c in columns) + ")" for t, columns in HOLDERS.items()}


def first_sql(tests: dict[str, str]) -> str:
    return "case " + " ".join(f"when {t} then '{n}'" for n, t in tests.items()) + " end"


@query(
    "context_carry",
    f"""
    with {TURNS},
      named as ({" union all ".join(f"select conv_id, turn, {i} as pos, '{n}' as name from turns where {t}" for i, (n, t) in enumerate(NAMED.items()))}),
      spoken as (select conv_id, turn, role = 'user' and {SPEAKING["difference"]} as d, role = 'user' and {SPEAKING["fusion"]} as f,
        role = 'user' and {SPEAKING["relation"]} as r from turns),
      past as (select t.conv_id, t.turn, coalesce(bool_or(s.d), false) as past_difference, coalesce(bool_or(s.f), false) as past_fusion,
        coalesce(bool_or(s.r), false) as past_relation
        from turns t left join spoken s on s.conv_id = t.conv_id and s.turn between t.turn - 6 and t.turn - 1 group by all),
      seen as (select t.conv_id, t.turn, arg_min(n.name, (t.turn - n.turn) * 100 + n.pos) as recent
        from turns t join named n on n.conv_id = t.conv_id and n.turn between t.turn - 6 and t.turn - 1 group by all)
    , aimed as (select t.*, past_difference, past_fusion, past_relation, recent,
      coalesce({first_sql({n: f"contains({FOLDED}, '{n.lower()}')" for n in CHAT_TABLES})},
        {first_sql({n: f"regexp_matches({FOLDED}, '\\b({a})\\b')" for n, a in ALIASES.items()})},
        case when len(list_filter([{", ".join(OWNERS.values())}], lambda x: x)) = 1 then {first_sql(OWNERS)} end,
        s.recent) as target
      from turns t join past p on p.conv_id = t.conv_id and p.turn = t.turn
      left join seen s on s.conv_id = t.conv_id and s.turn = t.turn),
    judged as (select *, coalesce({first_sql(MENTIONS)}, recent, target) as meant from aimed)
    select conv_id, turn, target, {intent_sql(again=True)} as intent from judged
    """,
)
def context_carry(spark, folder):
    """Target and request of each turn, with what the last six turns of its conversation say."""
    return L.annotate(_turns(spark, folder), _chat_tables(spark, folder)).select("conv_id", "turn", "target", "intent")
