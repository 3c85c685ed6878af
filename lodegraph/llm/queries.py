"""The queries of this subpackage, and DuckDB SQL for those that SQL can express.

SQL has no byte-pair encoding, XXH64, Feistel network, trained classifier, expectation-maximisation or false-discovery
control; what needs these is tested against brute force.
"""

from .byte_bpe import op1_byte_bpe
from .chunked_bpe import op11_chunked_bpe
from .decontaminate import op9_decontaminate
from .fill_in_middle import op12_fill_in_middle
from .language import op8_language
from .ngram_lm import op10_ngram_lm
from .pii import op4_pii
from .quality import op2_quality
from .secrets import op7_secrets
from .simhash import op3_simhash
from .toxicity import op6_toxicity
from .warc import op5_warc
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_simhash, op4_pii, op5_warc, op6_toxicity, op7_secrets, op8_language, op9_decontaminate, op10_ngram_lm, op11_chunked_bpe, op12_fill_in_middle, op13_whitening)}

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
l AS (SELECT r, doc_id, source, x, list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS x FROM d)),
lines AS (SELECT r, doc_id, source, x, array_to_string(ws, ' ') AS k, len(ws) AS n FROM l WHERE len(ws) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY 1),
frequent AS (SELECT source, k FROM lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
removed AS (SELECT r, sum(n)::BIGINT AS n FROM lines SEMI JOIN frequent USING (source, k) WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_line_words_removed
  FROM w LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_line_words_removed >= 0.5 * n_words AS kept FROM b"""

_WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS first FROM p GROUP BY 1),
r AS (SELECT p.*, CASE WHEN strlen(h) >= 1000 AND first <> page_id THEN first END AS refers_to FROM p JOIN g USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, coalesce(url, '') AS url FROM r"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATED = f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + 9], ' ') AS key FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 8))) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents), ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS key FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(1, len(ws) - n + 2))) AS p FROM d, ns)),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, key)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""

_FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {"op2_quality": _QUALITY, "op5_warc": _WARC, "op9_decontaminate": _CONTAMINATED, "op12_fill_in_middle": _FILL_IN_MIDDLE}
