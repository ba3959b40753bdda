from hexlode.plans.cache import QueryCache


def test_cache(spark):
    now = [0.0]
    c = QueryCache(2, 10, lambda: now[0])
    made = []
    ask = lambda k: c.get("vector", {"k": k}, lambda: made.append(k) or spark.range(k))
    assert ask(1).count() == 1 and ask(1).count() == 1 and made == [1]
    ask(2), ask(1), ask(3), ask(2)
    assert made == [1, 2, 3, 2]
    now[0] = 11
    assert c.expire() == 2 and c.stats() == {"size": 0, "hits": 2, "misses": 4, "hit_rate": 0.3333}
