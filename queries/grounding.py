"""Grounding queries: corpus, chunks, claims, retrieval, verdicts, citations, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import text as X
from corroborate.operators import chunks as C
from corroborate.operators import cite, claims, correct, retrieval, verify
from corroborate.plans.grounding import Grounding, chunk_store, ground
from corroborate.session import stage
from corroborate.sources import corpus as S
from queries import inputs as I
from queries import query

SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda w: w <> '')"


def tokens_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def content_sql(c: str) -> str:
    return f"list_filter(list_distinct({tokens_sql(c)}), lambda w: not list_contains({lst(L.STOP_WORDS)}, w))"


# --- shared SQL steps -----------------------------------------------------------

WALK = """
walk as (
  select doc_id, source, text, 0 as start, null::integer as stop, null::varchar as raw from documents
  union all
  select doc_id, source, text, nxt - 50, nxt, substring(text, start + 1, nxt - start)
  from (
    select *, case when start + 500 < length(text)
                    and length(regexp_extract(substring(text, start + 1, 500), '^(?s)(.*)[.\\n]', 1)) > 250
                   then start + length(regexp_extract(substring(text, start + 1, 500), '^(?s)(.*)[.\\n]', 1)) + 1
                   else start + 500 end as nxt
    from walk where start < length(text)
  )
),
"""
CHUNKS = (
    WALK
    + f"""
cut as (
  select *, stop - length(regexp_replace(raw, '^{SPACE}+', '')) as x,
         start + 50 as ended, {strip_sql('raw')} as body
  from walk where raw is not null
),
placed as (
  select doc_id, source, body, stop,
         lag(stop, 1) over (partition by doc_id order by stop) as before,
         raw
  from cut
),
chunks as (
  select cast(doc_id as varchar) || '_chunk_' || cast(row_number() over (partition by doc_id order by stop) - 1 as varchar) as chunk_id,
         doc_id, source,
         cast(row_number() over (partition by doc_id order by stop) - 1 as integer) as chunk_index,
         1 as page, cast(coalesce(before - 50, 0) + length(raw) - length(regexp_replace(raw, '^{SPACE}+', '')) as integer) as char_start,
         body as text
  from placed where body <> ''
)
"""
)
# `before` must see blank windows too, hence the filter after the window.

CLAIM_STEPS = f"""
sents as (
  select doc_id, pos, sent[pos] as s from (
    select doc_id, sent, unnest(range(1, len(sent) + 1)) as pos from (
      select doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(10), 'g'), chr(10)),
                                 lambda s: {strip_sql('s')} <> '') as sent
      from texts))
),
pieces as (
  select doc_id, pos, case when len({words_sql('s')}) > 20
     then list_transform(list_filter(string_split(replace(s, ';', '.'), '. '), lambda c: length(c) > 5), lambda c: {strip_sql('c')})
     else [{strip_sql('s')}] end as p
  from sents
),
claims as (
  select doc_id, cast(row_number() over (partition by doc_id order by pos, i) - 1 as integer) as claim_index, claim
  from (select doc_id, pos, unnest(range(1, len(p) + 1)) as i, unnest(p) as claim from pieces)
)
"""

EMBED = """
vec_of_{0} as (
  select id, b, cast(n / sqrt(sum(n * n) over (partition by id)) as float)::double as v
  from (select id, cast(('0x' || substring(md5(t), 7, 2)) as integer) as b, count(*)::double as n
        from (select id, unnest({1}) as t from {0}_in) group by 1, 2)
)
"""

FOUND = f"""
wording as (select distinct md5(claim) as query_id, claim from claims),
q_in as (select query_id as id, claim as text from wording),
c_in as (select chunk_id as id, text from chunks),
{EMBED.format('q', tokens_sql('text'))},
{EMBED.format('c', tokens_sql('text'))},
q_norm as (select id, sum(v * v) as n from vec_of_q group by id),
c_norm as (select id, sum(v * v) as n from vec_of_c group by id),
dots as (select q.id as qid, c.id as cid, sum(q.v * c.v) as d from vec_of_q q join vec_of_c c using (b) group by 1, 2),
ranked as (
  select q.id as query_id, c.id as chunk_id, round(1 - (q.n + c.n - 2 * coalesce(d, 0)), 6) as score,
         cast(row_number() over (partition by q.id order by round(1 - (q.n + c.n - 2 * coalesce(d, 0)), 6) desc, c.id) as integer) as rank
  from q_norm q cross join c_norm c left join dots on qid = q.id and cid = c.id
),
found as (select * from ranked where rank <= 5)
"""


def label_steps(source: str) -> str:
    """SQL from (claim, text, ...) rows to label and confidence."""
    neg = lst(L.NEGATIONS)
    return f"""
sided as (select *, {content_sql('claim')} as h, {content_sql('text')} as p from {source}),
covered as (select *, case when len(h) > 0 then len(list_intersect(h, p)) / len(h)::double else 0 end as cover,
   len(list_filter(h, lambda t: not list_contains(p, t) and regexp_matches(t, '\\p{{N}}'))) > 0
     and len(list_filter(p, lambda t: regexp_matches(t, '\\p{{N}}'))) > 0 as numbers,
   list_has_any(h, {neg}) <> list_has_any(p, {neg}) as negated
   from sided),
logits as (select *, (numbers and cover >= 0.5) or negated as clash from covered),
scored as (select * exclude (h, p, cover, numbers, negated, clash),
   case when clash then 4 * cover - 1 else -2.0 end as l0, 1.0::double as l1, case when clash then -2.0 else 6 * cover - 3 end as l2 from logits),
evidence as (select * exclude (l0, l1, l2),
   case when l0 >= l1 and l0 >= l2 then 'contradiction' when l1 >= l2 then 'neutral' else 'entailment' end as nli_label,
   round(1 / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) as confidence
   from scored)
"""


def any_of(c: str, phrases) -> str:
    return "(" + " or ".join("contains(lower(" + c + "), '" + p.replace("'", "''") + "')" for p in phrases) + ")"


PAIRS = """
pairs as (
  select query_id, w.claim, chunk_id, f.rank, c.text, c.source, c.page, f.score as retrieval_score
  from found f join chunks c using (chunk_id) join wording w using (query_id)
)
"""
DECIDE = f"""
flagged as (select *, nli_label = 'neutral' and {any_of('claim', L.CLAIM_PROHIBITIONS)} and {any_of('text', L.EVIDENCE_PROHIBITIONS)}
   and retrieval_score >= -0.1 as implied from evidence),
first_of as (
  select query_id,
    first(rank order by confidence desc, rank) filter (nli_label = 'entailment' and confidence >= 0.4) as e,
    first(rank order by confidence desc, rank) filter (nli_label = 'contradiction' and confidence >= 0.5) as c,
    first(rank order by rank) filter (implied) as i,
    first(rank order by confidence desc, rank) as u
  from flagged group by query_id
),
verdicts as (
  select k.doc_id, k.claim_index, k.claim,
    case when e is not null then 'supported' when c is not null or i is not null then 'contradicted' else 'unverifiable' end as status,
    e is null and c is null and i is not null as implicit_contradiction,
    coalesce(v.confidence, 0.0) as confidence, v.text as ev_text, v.source as ev_source, v.page as ev_page, v.rank as ev_rank,
    case when u is null then 'No relevant evidence found in source documents.'
      when e is not null then 'Claim is SUPPORTED by evidence on page ' || v.page || '. Confidence: ' || printf('%.2f%%', v.confidence * 100)
      when c is not null then 'Claim CONTRADICTS evidence on page ' || v.page || '. Confidence: ' || printf('%.2f%%', v.confidence * 100)
      when i is not null then 'Claim appears to CONTRADICT evidence on page ' || v.page || '. The source mentions different contraindications than the claim.'
      else 'Claim cannot be verified with high confidence. Evidence is either insufficient or neutral.' end as explanation
  from claims k left join first_of f on f.query_id = md5(k.claim)
  left join flagged v on v.query_id = f.query_id and v.rank = coalesce(e, c, i, u)
)
"""
TEXTS = "texts as (select item_id as doc_id, text from benchmark)"
GROUND = f"with recursive {CHUNKS}, {TEXTS}, {CLAIM_STEPS}, {FOUND}, {PAIRS}, {label_steps('pairs')}, {DECIDE}"


def job(spark: SparkSession, sf: str) -> Grounding:
    """Ingest the documents into a stored corpus, then check the benchmark texts against it."""
    return ground(I.generated(spark, sf), stage(chunk_store(I.corpus(spark, sf)), "store"))


# --- sources --------------------------------------------------------------------


@query("corpus_scan", "select substring(md5('documents/' || doc_id || '.txt'), 1, 8) as id, 'documents/' || doc_id || '.txt' as source, 1 as page, text from documents")
def corpus_scan(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.concat(F.lit("documents/"), "doc_id", F.lit(".txt")).alias("source"), "text")
    return docs.select(X.doc_id(F.col("source")).alias("id"), "source", F.lit(1).alias("page"), "text")


@query("doc_id", "select url, substring(md5(url), 1, 8) as doc_id from pages")
def doc_id(spark, sf):
    return I.table(spark, sf, "pages").select("url", X.doc_id(F.col("url")).alias("doc_id"))


@query(
    "page_spans",
    f"""with p as ({I.PAGED}),
    k as (select *, length(text) + 2 as n from p where length(text) > 0),
    s as (select doc_id, page, coalesce(sum(n) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as start, n from k)
    select doc_id, page, cast(start as bigint) as start, cast(start + n as bigint) as "end" from s""",
)
def page_spans(spark, sf):
    return S.page_spans(I.paged(spark, sf))


@query(
    "page_assembly",
    f"select doc_id, string_agg(text || chr(10) || chr(10), '' order by page) as text from ({I.PAGED}) where length(text) > 0 group by doc_id",
)
def page_assembly(spark, sf):
    return S.assemble_pages(I.paged(spark, sf))


@query("page_join", f"select doc_id, string_agg(coalesce(text, '') || chr(10), '' order by page) as text from ({I.PAGED}) group by doc_id")
def page_join(spark, sf):
    return S.join_pages(I.paged(spark, sf))


@query(
    "route_format",
    """select url, case when lower(url) like '%.pdf' then 'pdf' when lower(url) like '%.txt' then 'text' end as format,
       case when lower(url) not like '%.pdf' and lower(url) not like '%.txt' then 'Unsupported file type: ' || url end as reject_reason
       from (select case page_id % 3 when 0 then url || '.PDF' when 1 then url || '.txt' else url end as url from pages)""",
)
def route_format(spark, sf):
    kind = F.col("page_id") % 3
    named = I.table(spark, sf, "pages").select(
        F.when(kind == 0, F.concat("url", F.lit(".PDF"))).when(kind == 1, F.concat("url", F.lit(".txt"))).otherwise(F.col("url")).alias("url")
    )
    return S.route_formats(named, "url")


CHUNKED = f"with recursive {CHUNKS}"


@query(
    "kb_append",
    f"""{CHUNKED} select chunk_id, doc_id, cast(length(text) as integer) as n_chars from chunks
    where chunk_id not in (select chunk_id from chunks where chunk_index < 1)""",
)
def kb_append(spark, sf):
    chunks = C.chunk_documents(I.corpus(spark, sf))
    store = chunks.where(F.col("chunk_index") < 1)
    return S.new_chunks(chunks, store).select("chunk_id", "doc_id", F.length("text").alias("n_chars"))


# --- text -----------------------------------------------------------------------


@query("chunk_documents", f"{CHUNKED} select chunk_id, doc_id, source, chunk_index, text from chunks")
def chunk_documents(spark, sf):
    return C.chunk_documents(I.corpus(spark, sf)).select("chunk_id", "doc_id", "source", "chunk_index", "text")


@query("chunk_offsets", f"{CHUNKED} select chunk_id, char_start, cast(char_start + length(text) as integer) as char_end from chunks")
def chunk_offsets(spark, sf):
    return C.chunk_documents(I.corpus(spark, sf)).select("chunk_id", "char_start", "char_end")


@query(
    "chunk_pages",
    f"""with recursive paged as ({I.PAGED}),
    documents as (select p.doc_id, d.source, string_agg(p.text || chr(10) || chr(10), '' order by page) as text
      from paged p join main.documents d using (doc_id) where length(p.text) > 0 group by 1, 2),
    {CHUNKS},
    k as (select *, length(text) + 2 as n from paged where length(text) > 0),
    s as (select doc_id, page, coalesce(sum(n) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as start, n from k)
    select c.chunk_id, c.char_start, coalesce(s.page, 1) as page
    from chunks c left join s on s.doc_id = c.doc_id and c.char_start >= s.start and c.char_start < s.start + s.n""",
)
def chunk_pages(spark, sf):
    pages = I.paged(spark, sf)
    sources = I.table(spark, sf, "documents").select("doc_id", "source")
    chunks = C.chunk_documents(S.assemble_pages(pages).join(sources, "doc_id"))
    return C.locate_pages(chunks, S.page_spans(pages)).select("chunk_id", "char_start", "page")


@query("kb_inventory", f"{CHUNKED} select source, count(*) as chunks from chunks group by source")
def kb_inventory(spark, sf):
    return C.inventory(C.chunk_documents(I.corpus(spark, sf)))


CLAIMS_OF_ANSWERS = f"with texts as ({I.ANSWERS}), {CLAIM_STEPS}"


@query("atomize_claims", f"{CLAIMS_OF_ANSWERS} select * from claims")
def atomize_claims(spark, sf):
    return claims.atomize_claims(I.answers(spark, sf))


def _topic_sql() -> str:
    tags = ", ".join(f"case when {any_of('text', keys)} then '{t}' end" for t, keys in L.TOPICS.items())
    return f"list_filter([{tags}], lambda t: t is not null)"


@query(
    "topic_tags",
    f"select doc_id, coalesce(tags[1], 'general') as primary_topic, array_to_string(tags, ',') as all_topics from (select doc_id, {_topic_sql()} as tags from documents)",
)
def topic_tags(spark, sf):
    return claims.topic_tags(I.corpus(spark, sf)).withColumn("all_topics", F.array_join("all_topics", ","))


@query(
    "topic_sources",
    f"""with tagged as (select doc_id, coalesce(({_topic_sql()})[1], 'general') as topic from documents),
    s as (select case page_id % 5 when 0 then 'medical' when 1 then 'legal' when 2 then 'financial' when 3 then 'technical' else 'general' end as topic,
          page_id as priority, url from pages),
    r as (select *, cast(row_number() over (partition by topic order by priority, url) as integer) as rank from s)
    select doc_id, topic, rank, url from tagged join r using (topic) where rank <= 3""",
)
def topic_sources(spark, sf):
    topics = F.array(*map(F.lit, [*L.TOPICS, "general"]))
    sources = I.table(spark, sf, "pages").select(
        F.element_at(topics, (F.col("page_id") % 5 + 1).cast("int")).alias("topic"), F.col("page_id").alias("priority"), "url", F.col("url").alias("title")
    )
    return claims.topic_sources(claims.topic_tags(I.corpus(spark, sf)), sources).drop("title")


SPANS = f"""
gaps as (select c.doc_id, claim_index, claim, t.text, string_split(lower(t.text), lower(claim)) as g from claims c join texts t using (doc_id) where length(claim) > 0),
exact as (select doc_id, claim_index, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(claim) as integer) as start,
           cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(claim) as integer) as "end"
          from (select *, unnest(range(1, len(g))) as i from gaps)),
missed as (select *, array_to_string(({words_sql('claim')})[1:5], ' ') as head from gaps where len(g) = 1 and len({words_sql('claim')}) >= 5),
hgaps as (select *, string_split(lower(text), lower(head)) as hg from missed),
hstart as (select *, cast(list_sum(list_transform(hg[1:i], lambda x: length(x))) + (i - 1) * length(head) as integer) as start
           from (select *, unnest(range(1, len(hg))) as i from hgaps)),
fuzzy as (select doc_id, claim_index, start, cast(case when strpos(substring(text, start + length(head) + 1), '.') > 0
             then start + length(head) + strpos(substring(text, start + length(head) + 1), '.')
             else least(start + length(head) + 100, length(text)) end as integer) as "end" from hstart),
spans as (select * from exact union all select * from fuzzy)
"""


@query("claim_positions", f'{CLAIMS_OF_ANSWERS}, {SPANS} select doc_id, claim_index, start, "end" from spans')
def claim_positions(spark, sf):
    docs = I.answers(spark, sf)
    return cite.claim_positions(docs, claims.atomize_claims(docs)).select("doc_id", "claim_index", "start", "end")


@query(
    "best_sentence",
    f"""with texts as ({I.ANSWERS}), {CLAIM_STEPS},
    s as (select c.*, t.text, list_filter(list_transform(regexp_split_to_array(t.text, '[.!?]+'), lambda s: {strip_sql('s')}), lambda s: s <> '') as parts,
            list_distinct(list_filter(list_transform({words_sql('lower(claim)')}, lambda w: regexp_replace(w, '^[.,!?()\\[\\]{{}}]+|[.,!?()\\[\\]{{}}]+$', '', 'g')),
              lambda w: not list_contains({lst(L.STOP_WORDS)}, w))) as keys
          from claims c join texts t using (doc_id)),
    e as (select *, unnest(range(1, len(parts) + 1)) as i from s where len(parts) > 0),
    n as (select doc_id, claim_index, parts[i] as sentence, i, len(list_filter(keys, lambda w: contains(lower(parts[i]), w))) as score from e)
    select doc_id, claim_index, first(sentence order by score desc, i) as sentence from n group by 1, 2
    union all select doc_id, claim_index, text from s where len(parts) = 0""",
)
def best_sentence(spark, sf):
    docs = I.answers(spark, sf)
    pairs = claims.atomize_claims(docs).join(docs, "doc_id")
    return pairs.select("doc_id", "claim_index", X.best_sentence(F.col("claim"), F.col("text")).alias("sentence"))


# --- retrieval and verdicts -----------------------------------------------------


@query(
    "embed_chunks",
    f"""{CHUNKED}, c_in as (select chunk_id as id, text from chunks), {EMBED.format('c', tokens_sql('text'))}
    select id as chunk_id, count(*) as filled, round(sum(v), 4) as total, round(max(v), 5) as peak, cast(min(b) as integer) as first_bucket from vec_of_c group by id""",
)
def embed_chunks(spark, sf):
    store = chunk_store(I.corpus(spark, sf))
    full = store.select("chunk_id", F.posexplode("embedding").alias("b", "v")).where(F.col("v") > 0).withColumn("v", F.col("v").cast("double"))
    return full.groupBy("chunk_id").agg(
        F.count("*").alias("filled"), F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 5).alias("peak"), F.min("b").alias("first_bucket")
    )


TOPK = """select query_id, chunk_id, score, rank from (
  select a.vec_id as query_id, b.vec_id as chunk_id,
    round(1 - pow(list_distance(a.embedding::double[], b.embedding::double[]), 2), 6) as score,
    cast(row_number() over (partition by a.vec_id order by round(1 - pow(list_distance(a.embedding::double[], b.embedding::double[]), 2), 6) desc, b.vec_id) as integer) as rank
  from embeddings a cross join embeddings b) where rank <= 5"""


def _nearest(spark, sf):
    vectors = I.table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.evidence_topk(queries, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5)


@query("evidence_topk", TOPK)
def evidence_topk(spark, sf):
    return _nearest(spark, sf)


@query("evidence_gate", f"select * from ({TOPK}) where score > 0.3")
def evidence_gate(spark, sf):
    return retrieval.gate(_nearest(spark, sf), 0.3)


@query(
    "nli_softmax",
    """select vec_id, case when a >= b and a >= c then 'contradiction' when b >= c then 'neutral' else 'entailment' end as nli_label,
    round(1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) as confidence
    from (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)""",
)
def nli_softmax(spark, sf):
    rows = I.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("logits"))
    return verify.with_label(rows).drop("logits")


@query("evidence_scored", f"{GROUND} select query_id, chunk_id, rank, retrieval_score, nli_label, confidence from evidence")
def evidence_scored(spark, sf):
    return job(spark, sf).evidence.select("query_id", "chunk_id", "rank", "retrieval_score", "nli_label", "confidence")


@query("claim_verdict", f"{GROUND} select doc_id, claim_index, claim, status, confidence, ev_rank as evidence_rank, ev_text as evidence_text, explanation from verdicts")
def claim_verdict(spark, sf):
    return job(spark, sf).verdicts.select(
        "doc_id", "claim_index", "claim", "status", "confidence",
        F.col("evidence.rank").alias("evidence_rank"), F.col("evidence.text").alias("evidence_text"), "explanation",
    )


# Claims and passages in which every third word run is a prohibition, so that the rule can fire.
@query(
    "implicit_contradiction",
    f"""with p as (select doc_id, case when doc_id % 3 = 0 then 'You should not ' || text else text end as claim,
        case when doc_id % 2 = 0 then 'Contraindication: ' || text else text end as text,
        case when doc_id % 5 = 0 then 'entailment' else 'neutral' end as label, n_chars / 10000.0 - 0.3 as retrieval from documents)
    select doc_id, {any_of('claim', L.CLAIM_PROHIBITIONS)} and label = 'neutral' and {any_of('text', L.EVIDENCE_PROHIBITIONS)} and retrieval >= -0.1 as flagged from p""",
)
def implicit_contradiction(spark, sf):
    d = I.table(spark, sf, "documents")
    k = F.col("doc_id")
    p = d.select(
        "doc_id",
        F.when(k % 3 == 0, F.concat(F.lit("You should not "), "text")).otherwise(F.col("text")).alias("claim"),
        F.when(k % 2 == 0, F.concat(F.lit("Contraindication: "), "text")).otherwise(F.col("text")).alias("text"),
        F.when(k % 5 == 0, "entailment").otherwise("neutral").alias("label"),
        (F.col("n_chars") / 10000.0 - 0.3).alias("retrieval"),
    )
    return p.select("doc_id", verify.implicit_contradiction(F.col("claim"), F.col("text"), F.col("label"), F.col("retrieval")).alias("flagged"))


SCORES = """
scores as (
  select doc_id, total, supported, contradicted, unverifiable,
    case when total > 0 then greatest(0.0, least(1.0, supported / total - 0.5 * contradicted / total)) else 0.0 end as trust_score
  from (select t.doc_id, count(v.doc_id) as total, count(*) filter (status = 'supported') as supported,
          count(*) filter (status = 'contradicted') as contradicted, count(*) filter (status = 'unverifiable') as unverifiable
        from texts t left join verdicts v using (doc_id) group by 1)
)
"""


@query(
    "trust_score",
    f"{GROUND}, {SCORES} select doc_id, total, supported, contradicted, unverifiable, round(trust_score, 6) as trust_score from scores",
)
def trust_score(spark, sf):
    return job(spark, sf).scores().withColumn("trust_score", F.round("trust_score", 6))


@query(
    "verdict_pct",
    f"""{GROUND}, {SCORES} select doc_id,
    case when total > 0 then round(supported * 100.0 / total, 1) else 0 end as supported_pct,
    case when total > 0 then round(contradicted * 100.0 / total, 1) else 0 end as contradicted_pct,
    case when total > 0 then round(unverifiable * 100.0 / total, 1) else 0 end as unverifiable_pct from scores""",
)
def verdict_pct(spark, sf):
    return verify.verdict_percentages(job(spark, sf).scores())


@query(
    "evidence_lookup",
    f"""{GROUND} select k.doc_id, k.claim_index, v.rank, v.text, v.nli_label, v.confidence
    from claims k join flagged v on v.query_id = md5(k.claim) where k.claim_index = 0 and v.rank <= 3""",
)
def evidence_lookup(spark, sf):
    return verify.evidence_of(job(spark, sf).verdicts, 0).select("doc_id", "claim_index", "rank", "text", "nli_label", "confidence")


@query(
    "contradictions",
    f"{GROUND} select doc_id, claim_index, claim, confidence, explanation from verdicts where status = 'contradicted'",
)
def contradictions(spark, sf):
    return verify.contradictions(job(spark, sf).verdicts).select("doc_id", "claim_index", "claim", "confidence", "explanation")


@query(
    "run_stats",
    f"""{CHUNKED} select count(*) as total_runs, count(*) filter (ok) as completed_runs, round(avg(case when ok then quality end) * 100, 1) as average_trust,
    cast(sum(case when ok then toxic end) as bigint) as total_contradictions, (select count(*) from chunks) as store_size
    from (select *, doc_id % 7 <> 0 as ok from labels)""",
)
def run_stats(spark, sf):
    runs = I.table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 7 != 0, "completed").otherwise("running").alias("status"),
        F.col("quality").alias("trust_score"),
        F.col("toxic").alias("contradicted"),
    )
    return verify.run_stats(runs, C.chunk_documents(I.corpus(spark, sf)))


# --- citations and corrections --------------------------------------------------

CITED = f"""
{SPANS},
positions as (select s.doc_id, s.claim_index, s.start, s."end", v.claim, v.status, v.confidence, v.explanation, v.ev_text, v.ev_source, v.ev_page
              from spans s join verdicts v using (doc_id, claim_index)),
citations as (select *, cast(row_number() over (partition by doc_id order by claim_index, start) as integer) as citation_number
              from positions where status = 'supported' and ev_text is not null)
"""


@query(
    "citations",
    f"""{GROUND}, {CITED} select doc_id, 'cite_' || citation_number as id, claim_index, claim as claim_text, start, ev_source as source_file,
    ev_page as source_page, ev_text as evidence_text, confidence, citation_number from citations""",
)
def citations(spark, sf):
    return job(spark, sf).citations()


@query(
    "footnotes",
    f"""{GROUND}, {CITED} select doc_id, citation_number, printf('[%d] %s, Page %d: "%s..." (Confidence: %.0f%%)', citation_number, ev_source,
    ev_page, substring(ev_text, 1, 100), confidence * 100) as footnote from citations""",
)
def footnotes(spark, sf):
    return cite.footnotes(job(spark, sf).citations())


@query(
    "annotations",
    f"""{GROUND}, {CITED} select p.doc_id, p.start, p."end", p.status, p.confidence, p.claim_index, c.citation_number
    from positions p left join citations c using (doc_id, claim_index, start)""",
)
def annotations(spark, sf):
    return job(spark, sf).annotations().select("doc_id", "start", "end", "status", "confidence", "claim_index", "citation_number")


def _markup_sql() -> str:
    """Spans in order; each begins where the earlier ones have ended, so text is never repeated."""

    def safe(c: str) -> str:
        for raw, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = f"replace({c}, '{raw}', '{good}')"
        return c

    def piece(start: str, end: str) -> str:
        return safe(f"substring(text, {start} + 1, greatest({end} - {start}, 0))")

    colour = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in L.STATUS_COLOURS.items()) + " else '#ffffff' end"
    return f"""{GROUND}, {CITED},
    noted as (select p.doc_id, p.start, p."end", p.status, p.confidence, p.explanation, p.claim_index, c.citation_number, t.text,
        row_number() over w as k, coalesce(max(p."end") over (w rows between unbounded preceding and 1 preceding), 0) as upto, max(p."end") over (partition by p.doc_id) as ends
      from positions p left join citations c using (doc_id, claim_index, start) join texts t on t.doc_id = p.doc_id window w as (partition by p.doc_id order by p.start, p.claim_index, p."end")),
    marked as (select doc_id, string_agg({piece('upto', 'greatest(start, upto)')} || '<span class="claim ' || status || '" style="background-color: ' || {colour} ||
        '; padding: 2px 4px; border-radius: 3px;" data-claim-index="' || claim_index || '" data-confidence="' || printf('%.2f', confidence) || '" title="' || {safe('explanation')} || '">' ||
        {piece('greatest(start, upto)', '"end"')} || case when citation_number is not null then '<sup>[' || citation_number || ']</sup>' else '' end || '</span>', '' order by k) as body, max(ends) as ends
      from noted group by doc_id)
    select t.doc_id, coalesce(body, '') || {piece('coalesce(ends, 0)', 'length(text)')} as annotated_html from texts t left join marked m on m.doc_id = t.doc_id"""


@query("annotated_markup", _markup_sql())
def annotated_markup(spark, sf):
    g = job(spark, sf)
    return cite.annotated_markup(g.docs, cite.gather_annotations(g.annotations()))


FIXES = f"""
fix_in as (select *, list_filter(list_transform(regexp_split_to_array(ev_text, '[.!?]+'), lambda s: {strip_sql('s')}), lambda s: s <> '') as parts,
            list_distinct(list_filter(list_transform({words_sql('lower(claim)')}, lambda w: regexp_replace(w, '^[.,!?()\\[\\]{{}}]+|[.,!?()\\[\\]{{}}]+$', '', 'g')),
              lambda w: not list_contains({lst(L.STOP_WORDS)}, w))) as keys
          from verdicts where status = 'contradicted' and ev_text is not null),
fix_s as (select doc_id, claim_index, first(parts[i] order by len(list_filter(keys, lambda w: contains(lower(parts[i]), w))) desc, i) as sentence
          from (select *, unnest(range(1, len(parts) + 1)) as i from fix_in where len(parts) > 0) group by 1, 2),
fixes as (select f.doc_id, f.claim_index, f.claim, coalesce(sentence, ev_text) as sentence, ev_source, ev_page, confidence
          from fix_in f left join fix_s using (doc_id, claim_index))
"""


@query(
    "corrections",
    f"""{GROUND}, {FIXES} select doc_id, claim_index, claim as original_claim, sentence as suggested_correction, ev_source as source, ev_page as page,
    'The claim states: "' || substring(claim, 1, 100) || case when length(claim) > 100 then '...' else '' end || '"' || chr(10) || chr(10) ||
    'However, the source document states: "' || substring(sentence, 1, 100) || case when length(sentence) > 100 then '...' else '' end || '"' ||
    chr(10) || chr(10) || 'Please revise the claim to match the source document.' as explanation, confidence from fixes""",
)
def corrections(spark, sf):
    return job(spark, sf).corrections()


@query(
    "correction_summary",
    f"""{GROUND}, {FIXES}, n as (select *, row_number() over (partition by doc_id order by claim_index) as i from fixes),
    g as (select doc_id, count(*) as n, string_agg(i || '. ' || substring(claim, 1, 80) || '...' || chr(10) || '   Source: ' || ev_source || ', Page ' || ev_page || chr(10) ||
      '   Suggested correction available.' || chr(10) || chr(10), '' order by i) as lines from n group by doc_id)
    select t.doc_id, coalesce(n, 0) as total_contradictions, case when n is null then 'No contradictions found. All claims are either supported or unverifiable.'
      else 'Found ' || n || ' contradicted claim(s) that require correction:' || chr(10) || chr(10) || lines end as summary from texts t left join g using (doc_id)""",
)
def correction_summary(spark, sf):
    g = job(spark, sf)
    return correct.correction_summary(g.docs, g.corrections())


def _bracketed(spark, sf):
    """Every claim of every answer, to be put in brackets."""
    each = claims.atomize_claims(I.answers(spark, sf))
    return each.select("doc_id", "claim_index", F.col("claim").alias("original_claim"), F.concat(F.lit("["), "claim", F.lit("]")).alias("suggested_correction"))


@query(
    "corrected_document",
    f"""{CLAIMS_OF_ANSWERS}, folds as (select doc_id, list(claim order by length(claim) desc, claim_index) as cs from claims group by doc_id)
    select t.doc_id, case when cs is null then text else list_reduce(cs, lambda t, c: case when length(c) > 0 and strpos(lower(t), lower(c)) > 0
      then substring(t, 1, strpos(lower(t), lower(c)) - 1) || '[' || c || ']' || substring(t, strpos(lower(t), lower(c)) + length(c)) else t end, text) end as corrected_text
    from texts t left join folds f on f.doc_id = t.doc_id""",
)
def corrected_document(spark, sf):
    return correct.corrected_documents(I.answers(spark, sf), _bracketed(spark, sf))


@query(
    "grounding_report",
    f"""{GROUND}, {SCORES}, {CITED}, {FIXES} select s.doc_id, total, supported, contradicted, unverifiable, round(trust_score, 6) as trust_score, a.said as annotations, c.said as citations, f.said as corrections
    from scores s left join (select doc_id, string_agg(start || '-' || "end" || ' ' || status || ' ' || claim_index, chr(10) order by start, "end", claim_index) as said from positions group by 1) a using (doc_id)
    left join (select doc_id, string_agg(citation_number || ' ' || claim_index || ' ' || ev_source || ' ' || ev_page || ' ' || ev_text, chr(10) order by citation_number) as said from citations group by 1) c using (doc_id)
    left join (select doc_id, string_agg(claim_index || ' ' || claim || ' ' || sentence || ' ' || ev_source || ' ' || ev_page, chr(10) order by claim_index) as said from fixes group by 1) f using (doc_id)""",
)
def grounding_report(spark, sf):
    """One row per text, with what its annotations, citations and corrections say."""

    def said(name: str, order: list[str], *fields: str):
        lines = F.transform(F.array_sort(F.transform(name, lambda x: F.struct(*[x[c].alias(f"o{i}") for i, c in enumerate(order)], x.alias("x")))), lambda y: F.concat_ws(" ", *[y["x"][c] if c != "span" else F.concat_ws("-", y["x"]["start"], y["x"]["end"]) for c in fields]))
        return F.when(F.size(name) > 0, F.array_join(lines, "\n")).alias(name)

    report = job(spark, sf).report()
    return report.select(
        "doc_id", "total", "supported", "contradicted", "unverifiable", F.round("trust_score", 6).alias("trust_score"),
        said("annotations", ["start", "end", "claim_index"], "span", "status", "claim_index"),
        said("citations", ["citation_number"], "citation_number", "claim_index", "source_file", "source_page", "evidence_text"),
        said("corrections", ["claim_index"], "claim_index", "original_claim", "suggested_correction", "source", "page"),
    )
