"""Parts of the checking SQL."""

NON_WORD = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
SPARSE = f"list_filter(regexp_split_to_array(lower(text), '{NON_WORD}'), lambda x: length(x) > 1)"
SERVICE = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: length(x) > 1)"
SPACED = "list_filter(string_split(text, ' '), lambda x: x <> '')"
CHUNK_SQL = """chunks as (select doc_id || '#' || i as chunk_id, doc_id as document_id, cast(i as int) as chunk_index,
  cast(n as int) as total_chunks, substr(text, cast(i * 448 + 1 as bigint), 512) as content, lang, source
  from (select *, unnest(range(cast(n as bigint))) as i from (select *, greatest(1, ceil((length(text) - 64) / 448.0)) as n from documents)))"""
VECS = "vecs as (select vec_id as doc_id, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings)"
CORPUS = f"""{VECS}, corpus as (select doc_id, text, vec from documents left join vecs using (doc_id)), asked as (select item_id as qid, text, vec
  from benchmark join vecs on item_id = doc_id)"""


def words(xs: list[str]) -> str:
    """A list of strings."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def bm25(docs: str = "corpus", queries: str = "asked", k: int = 10) -> str:
    """CTEs that end in `sparse`: qid, doc_id, score, rank."""
    return f"""toks as (select doc_id, {SPARSE} as t from {docs}),
post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from toks) group by doc_id, term),
dfs as (select term, count(*) as df from post group by term),
st as (select count(*) as n, avg(len(t)) as avgdl from toks),
qt as (select qid, term, count(*) as times from (select qid, unnest({SPARSE}) as term from {queries}) group by qid, term),
scored as (select qid, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from qt join post using (term) join dfs using (term), st group by qid, doc_id),
sparse as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from scored where score >= 0 qualify rank <= {k})"""


def dense(k: int = 10) -> str:
    """CTEs that end in `dense`: qid, doc_id, score, rank."""
    return f"""sims as (select a.qid, c.doc_id, list_dot_product(a.vec, c.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(c.vec,
  c.vec))) as score from asked a, corpus c where c.vec is not null),
dense as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from sims qualify rank <= {k})"""


def fused(score: str, how: str = "full", extra: str = "", k: int = 10, name: str = "fused") -> str:
    """A CTE of the two arms with the score; v, rv, s, rs are theirs."""
    return f"""pairs as (select coalesce(d.qid, s.qid) as qid, coalesce(d.doc_id, s.doc_id) as doc_id, d.score as v, d.rank as rv, s.score as s,
  s.rank as rs from dense d {how} join sparse s on d.qid = s.qid and d.doc_id = s.doc_id),
{name} as (select qid, doc_id, score, source, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank
  from (select *, {score} as score,
  case when v is not null and s is not null then 'Both' when v is not null then 'Vector' else 'Sparse' end as source from (select * {extra}
  from pairs)) where score >= 0 qualify rank <= {k})"""


RRF = "coalesce(0.7 / (60 + rv), 0) + coalesce(0.3 / (60 + rs), 0)"
