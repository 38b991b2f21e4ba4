"""What plans have done."""


def shuffled_rows(df):
    """Rows that the shuffles of an executed plan have written, by the text of its exchanges."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found
