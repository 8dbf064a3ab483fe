import collections

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), collections.Counter(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)
