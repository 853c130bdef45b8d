"""What tests share."""

from statistics import median


def shuffle_reads(spark, run) -> list[list[int]]:
    """The rows that each task of each stage of a run read from shuffles, for stages with several such tasks."""
    sc = spark.sparkContext._jsc.sc()
    store, numbers = sc.statusStore(), sc.dagScheduler().nextStageId()
    run()
    sc.listenerBus().waitUntilEmpty(30_000)
    out = []
    for stage in range(numbers, sc.dagScheduler().nextStageId()):
        tasks = store.taskList(stage, 0, 10_000)
        read = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]
        if sum(read):
            out.append(read)
    return out


def evenness(reads: list[int]) -> float:
    """The largest task's rows as times the median's, among tasks that read any."""
    return max(reads) / median(r for r in reads if r)
