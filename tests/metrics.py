"""What Spark has counted."""


def most_rows(spark):
    """The most rows that any step of the last query has put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList()
    last = done.apply(done.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for m in (metrics.apply(j) for j in range(metrics.size())):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most
