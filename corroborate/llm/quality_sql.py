"""The quality query in SQL: base measures by position, distances from counts in long form."""

_WHITE = r"[\x20\x09-\x0D]"
_CLASSES = {
    1: r"\p{Lu}",
    2: r"\p{Nd}",
    3: r"[.,;:''\"?()\-]",
    4: r"[#*$%&|<>]",
    5: r"[!+/=@\[\\\]^_`{}~]",
}


def _count(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def quality_sql(limits) -> str:
    """SQL for :func:`corroborate.llm.quality.quality` on texts whose letters are Latin."""
    classes = ", ".join(f"({_count(p)})::DOUBLE AS k{k}" for k, p in _CLASSES.items())
    far = f"(n_words >= {limits.char_guard} AND char_d > {limits.char_limit} + {limits.char_slack} / sqrt(n_words)) OR (n_words >= {limits.word_guard} AND word_d > {limits.word_limit} + {limits.word_slack} / sqrt(n_words))"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
rep AS (
    SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
    FROM (SELECT doc_id, i, unnest(range(5)) AS o FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
base AS (
    SELECT d.doc_id, lang, t, words, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_WHITE}+', '', 'g'))::BIGINT AS word_chars,
           ({_count(_CLASSES[4])})::BIGINT AS n_symbols, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines
    FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
shapes AS (SELECT doc_id, lang, base_failed, ({_count(_WHITE)})::DOUBLE AS k0, {classes}, ({_count(r"\p{L}")} - ({_count(_CLASSES[1])}))::DOUBLE AS k6, length(t)::DOUBLE AS every FROM judged),
long AS (
    SELECT doc_id, lang, base_failed, every, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([k0, k1, k2, k3, k4, k5, k6, every - k0 - k1 - k2 - k3 - k4 - k5 - k6]) AS n FROM shapes),
ref AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM long WHERE NOT base_failed GROUP BY lang, k),
chars AS (
    SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS char_d
    FROM (SELECT doc_id, n / every AS p, q FROM long JOIN ref ON long.lang = ref.lang AND long.k = ref.k WHERE every > 0) GROUP BY doc_id),
tokens AS (SELECT doc_id, lang, base_failed, unnest(list_transform(words, lambda x: lower(x))) AS word FROM judged),
own AS (SELECT doc_id, word, count(*) AS c FROM tokens GROUP BY doc_id, word),
uses AS (SELECT lang, word, count(*) AS c, sum(count(*)) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM tokens WHERE NOT base_failed GROUP BY lang, word),
top AS (SELECT lang, word, c / total AS q FROM uses WHERE r <= {limits.common}),
pairs AS (
    SELECT j.doc_id, j.n_words, top.word, coalesce(own.c, 0) / j.n_words::DOUBLE AS p, q FROM judged j JOIN top ON j.lang = top.lang LEFT JOIN own ON own.doc_id = j.doc_id AND own.word = top.word WHERE j.n_words > 0),
whole AS (SELECT doc_id, p, q FROM pairs UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM pairs GROUP BY doc_id),
wordy AS (
    SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS word_d FROM whole GROUP BY doc_id)
SELECT judged.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({far}) AS kept
FROM judged LEFT JOIN chars ON judged.doc_id = chars.doc_id LEFT JOIN wordy ON judged.doc_id = wordy.doc_id
"""
