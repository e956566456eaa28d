"""The same model as common table expressions of standard SQL."""

from zbior.functions import tokens as tk
from zbior.functions import urls as ur
from zbior.plans.model import ADDRESS, AUTHOR_SEPARATORS, OWN_DOMAINS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _latest(name: str) -> str:
    return f"SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1"


def _in(kind: str, general: list[str]) -> str:
    return f"domain IN ({quoted([*general, *OWN_DOMAINS.get(kind, ())])})"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


RELIGIOUS = f"({_in('religious', ur.RELIGIOUS_DOMAINS)} OR {matches('domain', ur.RELIGIOUS_PARTS)})"
EDUCATIONAL = f"({_in('educational', ur.EDUCATIONAL_DOMAINS)} OR {matches('domain', ur.EDUCATIONAL_PARTS)})"
MEDIA = f"({_in('media', ur.MEDIA_DOMAINS)} OR {matches('domain', ur.MEDIA_PARTS)})"
SOCIAL = f"({_in('social', ur.SOCIAL_DOMAINS)})"

_pos = f"""CASE WHEN {matches('token', '^[0-9]+$')} THEN 'NUM' WHEN token IN ({quoted(tk.PREPOSITIONS)}) THEN 'ADP' WHEN token IN ({quoted(tk.CONJUNCTIONS)}) THEN 'CCONJ'
  WHEN {matches('token', tk.ADJECTIVE)} THEN 'ADJ' WHEN {matches('token', tk.VERB)} THEN 'VERB' WHEN {matches('token', tk.ADVERB)} THEN 'ADV' ELSE 'NOUN' END"""
_case = f"""CASE WHEN {matches('token', '(?:owi|emu)$')} THEN 'Dat' WHEN {matches('token', '(?:ach|ech|ych)$')} THEN 'Loc' WHEN {matches('token', '(?:ami|em|ymi)$')} THEN 'Ins'
  WHEN {matches('token', '(?:ów|ego|y|i)$')} THEN 'Gen' WHEN {matches('token', 'ę$')} THEN 'Acc' ELSE 'Nom' END"""
_gender = f"CASE WHEN {matches('token', '(?:a|ej|ą|ę)$')} THEN 'Fem' WHEN {matches('token', '(?:o|e)$')} THEN 'Neut' ELSE 'Masc' END"
_entity = " UNION ALL ".join(f"SELECT id, thread_id, '{k}' AS label, unnest(regexp_extract_all(content, '{p}')) AS entity FROM posts" for k, p in tk.ENTITIES.items())

MODEL = f"""WITH posts AS ({_latest('forum_posts')}), threads AS ({_latest('forum_threads')}), users AS ({_latest('forum_users')}),
places AS (SELECT t.id AS thread_id, s.id AS section_id, s.title AS section, f.id AS forum_id, f.spider_name AS forum, f.title AS forum_title
  FROM threads t JOIN forum_sections s ON t.section_id = s.id JOIN forums f ON s.forum_id = f.id),
tokens AS (SELECT id, thread_id, unnest(generate_series(0, len(w) - 1)) AS position, unnest(w) AS token
  FROM (SELECT id, thread_id, regexp_extract_all(lower(content), '{tk.WORD}') AS w FROM posts) WHERE len(w) > 0),
annotated AS (SELECT *, {_pos} AS pos, {matches('token', '^[[:alpha:]]+$').replace('[[:alpha:]]', chr(92) + 'p{L}')} AS is_alpha, token IN ({quoted(tk.STOP)}) AS is_stop, {_case} AS case_form, {_gender} AS gender FROM tokens),
ling AS (SELECT p.id, p.thread_id, p.created_at, p.user_id, k.n AS word_count, length(p.content) AS char_count,
    len(list_filter(regexp_split_to_array(p.content, '[.!?…]+'), LAMBDA s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))) AS sentence_count,
    CASE WHEN k.p + k.m > 0 THEN (k.p - k.m) / (k.p + k.m)::DOUBLE ELSE 0.0 END AS polarity,
    CASE WHEN k.p + k.m > 0 THEN least(1.0, (k.p + k.m + 0.5::DOUBLE * k.r) / k.n) WHEN k.r > 0 THEN least(1.0, k.r / k.n::DOUBLE) ELSE 0.0::DOUBLE END AS subjectivity
  FROM posts p JOIN (SELECT id, count(*) AS n, count(*) FILTER (token IN ({quoted(tk.POSITIVE)})) AS p, count(*) FILTER (token IN ({quoted(tk.NEGATIVE)})) AS m, count(*) FILTER (token IN ({quoted(tk.RELIGIOUS)})) AS r FROM tokens GROUP BY id) k ON p.id = k.id),
linguistics AS (SELECT *, word_count / sentence_count::DOUBLE AS avg_sentence_length, 206.835::DOUBLE - 1.015::DOUBLE * (word_count / sentence_count::DOUBLE) - 84.6::DOUBLE * (char_count / word_count::DOUBLE) AS raw_readability FROM ling),
links AS (SELECT id, thread_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[^:]+://([^/?#]*)', 1), '^www\\.', ''), '') AS domain
  FROM (SELECT id, thread_id, unnest(regexp_extract_all(replace(content_urls, '\\/', '/'), '{ADDRESS.replace("'", "''")}')) AS url FROM posts)),
urls AS (SELECT *, CASE category WHEN 'religious' THEN 0.9::DOUBLE WHEN 'educational' THEN 0.8::DOUBLE WHEN 'media' THEN 0.7::DOUBLE WHEN 'social' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM (
  SELECT *, CASE WHEN {RELIGIOUS} THEN 'religious' WHEN {EDUCATIONAL} THEN 'educational' WHEN {MEDIA} THEN 'media' WHEN {SOCIAL} THEN 'social' ELSE 'unknown' END AS category,
  CASE WHEN {matches('lower(url)', ur.VIDEO)} THEN 'video' WHEN {matches('lower(url)', ur.IMAGE)} THEN 'image' WHEN {matches('lower(url)', ur.ARTICLE)} THEN 'article' WHEN domain IN ({quoted(ur.SOCIAL_DOMAINS)}) THEN 'social' ELSE 'unknown' END AS url_type FROM links)),
domains AS (SELECT domain, any_value(category) AS category, any_value(trust) AS trust, count(*) AS total_references FROM urls GROUP BY domain),
entities AS (SELECT * FROM ({_entity}) WHERE trim(entity) <> ''),
authors AS (SELECT DISTINCT name FROM (SELECT regexp_replace(unnest(regexp_split_to_array(article_authors, '{AUTHOR_SEPARATORS.replace("'", "''")}')), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS name FROM articles) WHERE length(name) > 3)
"""
