"""DuckDB SQL for the operators that SQL can express.

Constants are written out here on purpose, apart from the operators' own.
"""

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
wins AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM wins) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
raw AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs),
live AS (
  SELECT rid, line, k,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM live GROUP BY rid),
flat AS (
  SELECT l.rid, d.source, d.t, len(w.w) AS n_words, ('0x' || md5(l.norm)[1:15])::BIGINT AS line,
    sum(len(string_split(l.norm, ' '))) AS n
  FROM live l JOIN docs d USING (rid) JOIN words w USING (rid) GROUP BY l.rid, d.source, d.t, len(w.w), l.norm),
texts AS (SELECT DISTINCT source, t, n_words, line, n FROM flat),
frequent AS (SELECT source, line FROM texts GROUP BY source, line HAVING count(*) > 20),
held AS (SELECT x.* FROM texts x JOIN frequent f ON x.line = f.line AND x.source IS NOT DISTINCT FROM f.source),
suspects AS (
  SELECT source, t, min(line) AS least FROM held GROUP BY source, t, n_words HAVING sum(n) >= 0.5 * n_words),
sizes AS (SELECT source, least, count(*) AS size FROM suspects GROUP BY source, least),
theirs AS (SELECT h.*, s.least FROM held h JOIN suspects s ON h.t = s.t AND h.source IS NOT DISTINCT FROM s.source),
core AS (
  SELECT a.source, a.least, a.line FROM (SELECT source, least, line, count(*) AS n FROM theirs GROUP BY ALL) a
    JOIN sizes z ON a.least = z.least AND a.source IS NOT DISTINCT FROM z.source WHERE a.n >= 0.8 * z.size),
copies AS (
  SELECT a.source, a.t, a.least FROM theirs a JOIN core c
    ON a.line = c.line AND a.least = c.least AND a.source IS NOT DISTINCT FROM c.source
  GROUP BY a.source, a.t, a.least, a.n_words HAVING sum(a.n) >= 0.5 * a.n_words),
counted AS (
  SELECT DISTINCT h.source, h.line, CASE WHEN c.least IS NULL THEN h.t ELSE 'copies of ' || c.least END AS document,
    c.least IS NULL AS own
  FROM held h LEFT JOIN copies c ON h.t = c.t AND h.source IS NOT DISTINCT FROM c.source),
often AS (SELECT source, line FROM counted GROUP BY source, line HAVING count(*) > 20),
lost AS (
  SELECT f.rid, sum(f.n) AS n FROM flat f JOIN often o
    ON f.line = o.line AND f.source IS NOT DISTINCT FROM o.source GROUP BY f.rid),
base AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM docs d JOIN words w USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)
    LEFT JOIN lost USING (rid)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 2 * (n_words - n_removed_words) >= n_words AS kept, n_removed_words
FROM judged
"""


def _licenses() -> str:
    texts = {
        "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
               "documentation files the software to deal in the software without restriction including without limitation "
               "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
               "permit persons to whom the software is furnished to do so",
        "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                  "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
                  "software distributed under the license is distributed on an as is basis",
        "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
               "public license as published by the free software foundation either version 3 of the license or at your "
               "option any later version",
        "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
               "the following conditions are met redistributions of source code must retain the above copyright notice "
               "this list of conditions and the following disclaimer",
        "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
               "granted provided that the above copyright notice and this permission notice appear in all copies",
        "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
               "not distributed with this file you can obtain one at",
    }
    values = ", ".join(f"('{k}', '{v}')" for k, v in texts.items())
    return r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS w0 FROM docs),
near AS (SELECT rid, pos, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3
  FROM flat WINDOW o AS (PARTITION BY rid ORDER BY pos)),
places AS (
  SELECT rid, pos, CASE WHEN w0 = 'mit' AND w1 = 'license' THEN 'mit' WHEN w0 = 'apache' AND w1 = 'license' THEN 'apache'
    WHEN w0 = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl' END AS label FROM near),
base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places WHERE label IS NOT NULL GROUP BY rid),
texts(label, t) AS (VALUES """ + values + r"""),
tflat AS (SELECT label, len(string_split(t, ' ')) AS size, unnest(range(len(string_split(t, ' ')))) AS tpos,
  unnest(string_split(t, ' ')) AS w0 FROM texts),
tnear AS (SELECT label, size, tpos, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3
  FROM tflat WINDOW o AS (PARTITION BY label ORDER BY tpos)),
votes AS (
  SELECT n.rid, t.label, t.size, t.tpos, n.pos, n.pos - t.tpos AS diag
  FROM near n JOIN tnear t ON n.w0 = t.w0 AND n.w1 = t.w1 AND n.w2 = t.w2 AND n.w3 = t.w3),
diags AS (SELECT DISTINCT rid, label, diag FROM votes),
steps AS (SELECT rid, label, diag,
  CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, label ORDER BY diag) <= 8 THEN 0 ELSE 1 END AS step FROM diags),
marked AS (SELECT rid, label, diag, sum(step) OVER (PARTITION BY rid, label ORDER BY diag) AS span FROM steps),
cells AS (SELECT v.rid, v.label, v.size, m.span, v.pos, v.pos + 4 AS pend, unnest(range(v.tpos, v.tpos + 4)) AS c
  FROM votes v JOIN marked m USING (rid, label, diag)),
spans AS (SELECT rid, label, size, count(DISTINCT c) AS covered, max(pend) - min(pos) AS length
  FROM cells GROUP BY rid, label, size, span),
best AS (SELECT rid, max(covered / size) AS coverage,
  coalesce(list(DISTINCT label) FILTER (covered >= 0.6 * size AND covered >= 0.6 * length), []) AS labels
  FROM spans GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
  b.last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(s.coverage, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base b USING (rid) LEFT JOIN best s USING (rid)
"""


SQL["op1_license_scan"] = _licenses()

SQL["op11_fill_in_middle"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
hashes AS (
  SELECT doc_id, t, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
    ('0x' || d[25:32])::BIGINT AS h4, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM docs),
cut AS (
  SELECT doc_id, t, h4, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM hashes),
parts AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
