def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_ids(got, docs):
    key = lambda x: (x is None, x)
    return sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in rows_of(docs)), key=key)
