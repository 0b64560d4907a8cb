"""DuckDB SQL for the operators that SQL can express; independent of the Spark plans."""

from __future__ import annotations

from plotwise.llm.licences import BASE_PHRASES, TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences(least: float = 0.8) -> str:
    words = [(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    heads = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        heads.append((t, label, len(w), at, len(k)))
    return f"""
WITH tw(t, i, word) AS (VALUES {",".join(f"({t},{i},{_quoted(w)})" for t, i, w in words)}),
th(t, label, n, key_at, key_n) AS (VALUES {",".join(f"({t},{_quoted(label)},{n},{at},{k})" for t, label, n, at, k in heads)}),
bp(phrase, label, n) AS (VALUES {",".join(f"({_quoted(p)},{_quoted(label)},{len(p.split())})" for p, label in BASE_PHRASES)}),
bw AS (SELECT phrase, label, n, unnest(string_split(phrase,' ')) AS word, generate_subscripts(string_split(phrase,' '),1)-1 AS i FROM bp),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM d),
hit AS (SELECT doc_id, label, pos-i AS start FROM w JOIN bw USING (word) GROUP BY doc_id, phrase, label, n, pos-i HAVING count(*)=n),
base AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word, list(DISTINCT label) AS labels FROM hit GROUP BY doc_id),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM documents)+1)::DOUBLE/(count(DISTINCT w.doc_id)+1))+1e-9 AS idf FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN w USING (word) GROUP BY v.word),
run AS (SELECT t, i, word, max(idf) OVER g AS heaviest, coalesce(sum(idf) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS upto, sum(idf) OVER (PARTITION BY t) AS all_ FROM tw JOIN idf USING (word) WINDOW g AS (PARTITION BY t ORDER BY idf DESC, word, i)),
posted AS (SELECT t, i, word FROM run WHERE upto=0 OR upto-heaviest<=(1-{least})*all_),
vote AS (SELECT doc_id, p.t, pos-p.i AS start, count(*) AS n FROM w JOIN posted p USING (word) GROUP BY doc_id, p.t, pos-p.i HAVING count(*)>=2),
fit AS (SELECT v.doc_id, v.t, v.start, sum(idf.idf) AS got, count(*) FILTER (tw.i>=th.key_at AND tw.i<th.key_at+th.key_n) AS key_hits FROM vote v JOIN th USING (t) JOIN tw USING (t) JOIN idf ON idf.word=tw.word JOIN w ON w.doc_id=v.doc_id AND w.pos=v.start+tw.i AND w.word=tw.word GROUP BY v.doc_id, v.t, v.start),
whole AS (SELECT t, sum(idf) AS all_ FROM tw JOIN idf USING (word) GROUP BY t),
found AS (SELECT doc_id, label, got/all_ AS share FROM fit JOIN th USING (t) JOIN whole USING (t) WHERE key_hits=key_n AND got/all_>={least}),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base,0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels),','),'') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels,[]),coalesce(best.labels,[])))),',') AS labels, CASE WHEN base.labels IS NOT NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE,round(coalesce(share,0),9)) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""


MIXING = """
WITH c AS (SELECT coalesce(source,'') AS s, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) FROM c)/(SELECT sum(sqrt(n)) FROM c)*sqrt(n)/n AS rate FROM c),
p AS (SELECT s, k, sum(exp(-rate+k*ln(rate)-lgamma(k+1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM r, range(200) t(k)),
u AS (SELECT d.*, coalesce(source,'') AS s, ('0x'||substr(md5('42:'||coalesce(doc_id::VARCHAR,'')),1,13))::UBIGINT::DOUBLE/4503599627370496.0::DOUBLE AS u FROM documents d),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM p WHERE p.s=u.s AND p.cdf<=u.u) AS m FROM u)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS mix_copy, ('0x'||substr(md5('42:'||coalesce(doc_id::VARCHAR,'')||':'||k::VARCHAR),1,15))::BIGINT AS mix_key FROM (SELECT *, unnest(range(1,m+1)) AS k FROM n WHERE m>0)"""

REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS x, octet_length(encode(coalesce(text,''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x,2*i+1,100) AS s FROM (SELECT doc_id, x, unnest(range(0,n-49)) AS i FROM h WHERE n>=50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id>first),
b AS (SELECT doc_id, unnest(range(0,n)) AS p, x FROM h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i,i+50)) AS p FROM g)),
m AS (SELECT b.doc_id, b.p, substr(x,2*b.p+1,2) AS byte, gone.p IS NOT NULL AS out_ FROM b LEFT JOIN gone ON gone.doc_id=b.doc_id AND gone.p=b.p),
r AS (SELECT doc_id, p, byte, out_, out_ AND NOT coalesce(lag(out_) OVER (PARTITION BY doc_id ORDER BY p),false) AS begins FROM m)
SELECT h.doc_id, n::BIGINT AS n_bytes, count(*) FILTER (out_)::BIGINT AS n_removed, count(*) FILTER (begins)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(byte,'' ORDER BY p) FILTER (NOT out_),''))) AS kept_sha256
FROM h LEFT JOIN r USING (doc_id) GROUP BY h.doc_id, n"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND list_sum(list_transform(e, lambda x: x*x))>0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id<>b.vec_id AND len(a.e)=len(b.e) AND list_cosine_similarity(a.e,b.e)>=0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n,0)::BIGINT AS n_links, least(v.vec_id,coalesce(c.c,v.vec_id)) AS component_id, v.vec_id<=coalesce(c.c,v.vec_id) AS kept FROM v LEFT JOIN n ON n.a=v.vec_id LEFT JOIN c ON c.a=v.vec_id"""
