"""Operators of a training-data pipeline (see README, section "llm").

Nothing outside this subpackage imports it. Shared rules:

* a row of ``documents`` is known by ``(doc_id, xxhash64(text))``, or by a
  number given once in a stored table, never by ``doc_id`` alone: null ids
  and repeated rows keep their own result rows;
* a null text is an empty text;
* an operator selects the columns it reads, so further columns of any name
  are carried or ignored, never confused with its own;
* lineage is cut by tables in the folder named by ``spark.checkpoint.dir``.
"""
