"""DuckDB SQL for the queries of this subpackage that SQL can express.

They look at every place, pair or window; constants are written out here, not
taken from the operators.
"""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
phrase(label, p) AS (VALUES
  ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
notice(label, need, p) AS (SELECT label, need, string_split(t, ' ') FROM (VALUES
  ('apache-2.0', 1.0, 'licensed under the apache license version 2 0'),
  ('apache-2.0', 0.8, 'unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis'),
  ('mit', 1.0, 'released under the mit license'),
  ('mit', 1.0, 'licensed under the mit license'),
  ('mit', 0.8, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  ('bsd', 0.8, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('gpl-3.0', 1.0, 'licensed under the gnu general public license version 3'),
  ('gpl-notice', 0.8, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  ('mpl-2.0', 1.0, 'subject to the terms of the mozilla public license v 2 0'),
  ('cc-by-nc', 1.0, 'licensed under cc by nc 4 0'),
  ('cc-by-4.0', 0.9, 'licensed under a creative commons attribution 4 0 international license'),
  ('spdx', 1.0, 'spdx license identifier')) x(label, need, t)),
place AS (
  SELECT doc_id, label, i - 1 AS start
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d), phrase
  WHERE w[i:i + len(p) - 1] = p),
block AS (
  SELECT doc_id, label, len(list_intersect(p, w[k:k + 2 * len(p) - 1])) / len(list_distinct(p)) AS share, need
  FROM (SELECT doc_id, w, label, p, need, unnest(generate_series(1, len(w))) AS k FROM d, notice)),
found AS (
  SELECT doc_id, label, 1.0 AS share, start, true AS base FROM place
  UNION ALL SELECT doc_id, label, share, NULL, false FROM block WHERE share >= need - 1e-9)
SELECT d.doc_id, len(any_value(w)) AS n_words, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""


def _escaped(text: str) -> str:
    marks = r"'(<)(/?s>|/?SYS>|\||unk>|pad>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'"
    return rf"regexp_replace(replace({text}, '\', '\\'), {marks})"


_OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, words)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM piece),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
place AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
freq AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM place GROUP BY ALL HAVING count(*) >= 100),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
inside AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (
    SELECT lang, a, w, m, unnest(generate_series(1, k - m + 1)) AS i
    FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM candidate))),
longest AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
kept AS (SELECT c.* FROM candidate c LEFT JOIN longest USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN freq x ON c.lang = x.lang AND c.x = x.phrase JOIN freq y ON c.lang = y.lang AND c.y = y.phrase
  JOIN words ON c.lang = words.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_licenses": _OP1, "op2_top_k": _OP2, "op4_chat": _OP4, "op5_decontamination": _OP5, "op12_collocations": _OP12}
