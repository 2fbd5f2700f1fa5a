"""Text reports of small result tables, which come to the driver: datasets by methods."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.stats import choose_tests, competition_ranks

#: Measures of the general report: title, how a value is shown, how a mean is, and the value that stands for none.
MEASURES: dict[str, tuple[str, str, str, float | None]] = {
    "io_until_first_other": ("IO accounts before the first other", ".0f", ".2f", None),
    "users_to_90": ("Users until 90 % of IO accounts", ".0f", ".2f", -1.0),
    "precision_100": ("Precision at 100", ".4f", ".4f", None),
    "precision_500": ("Precision at 500", ".4f", ".4f", None),
    "total_io": ("IO accounts ranked", ".0f", ".2f", None),
    "total_accounts": ("Accounts ranked", ".0f", ".2f", None),
}
#: Datasets times methods of a report, at most.
MAX_CELLS = 1_000_000


def ci_report(intervals: DataFrame, dataset: str, metric: str, level: float = 95.0) -> str:
    """Text of the intervals of one dataset and metric, a row per method."""
    rows = intervals.filter((F.col("dataset") == dataset) & (F.col("metric") == metric)).orderBy("method").collect()
    lines = [f"Bootstrap intervals, {metric}, {dataset}, {level:g} %", ""]
    for r in rows:
        lines += [f"{r['method']}:", f"  Mean: {r['mean']:.4f}", f"  CI: [{r['lower']:.4f}, {r['upper']:.4f}]", ""]
    return "\n".join(lines)


def score_matrix(scores: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Datasets, methods and their scores ``(dataset, method, score)``, names in order; nan where there is none."""
    rows = scores.select("dataset", "method", "score").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"a report has at most {MAX_CELLS} cells")
    datasets, methods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    matrix = np.full((len(datasets), len(methods)), np.nan)
    for dataset, method, score in rows:
        matrix[datasets.index(dataset), methods.index(method)] = np.nan if score is None else score
    return datasets, methods, matrix


def _grid(corner: str, columns: list[str], rows: list[tuple[str, list[str]]]) -> list[str]:
    """Lines of a table with a column of names and right-aligned cells."""
    first = max([len(corner), *[len(n) for n, _ in rows]])
    wide = [max([len(c), *[len(cells[i]) for _, cells in rows]]) for i, c in enumerate(columns)]
    line = lambda name, cells: "  ".join([name.ljust(first), *[c.rjust(w) for c, w in zip(cells, wide)]]).rstrip()
    return [line(corner, columns), *[line(n, cells) for n, cells in rows]]


def _table(names: list[str], methods: list[str], matrix: np.ndarray, last: str, cell: str, mean: str) -> list[str]:
    """A matrix with its column means, nan shown as NA and left out of the means."""
    show = lambda v, form: "NA" if np.isnan(v) else format(v, form)
    means = [column[~np.isnan(column)].mean() if (~np.isnan(column)).any() else np.nan for column in matrix.T]
    rows = [(n, [show(v, cell) for v in row]) for n, row in zip(names, matrix)]
    return _grid("dataset", methods, [*rows, (last, [show(v, mean) for v in means])])


def matrix_report(scores: DataFrame, title: str, missing: float | None = None) -> str:
    """Text of ``scores(dataset, method, score)``: a row per dataset, a column per method, means below.

    Scores equal to ``missing`` print as NA and stay out of the mean.
    """
    datasets, methods, matrix = score_matrix(scores)
    if not datasets:
        return title
    if missing is not None:
        matrix[matrix == missing] = np.nan
    return "\n".join([title, *_table(datasets, methods, matrix, "Average", ".4f", ".4f")])


def _tests(methods: list[str], matrix: np.ndarray) -> list[str]:
    found = choose_tests(matrix)
    if "wilcoxon" in found:
        w = found["wilcoxon"]
        lines = ["Wilcoxon signed ranks", f"  statistic {w.statistic:.4f}, p {w.p_value:.6f}, median difference {w.median_difference:.4f}"]
        if w.p_value < 0.05:
            lines.append(f"  better: {methods[0] if w.median_difference > 0 else methods[1]}")
        return lines
    statistic, p = found["friedman"]
    n = found["nemenyi"]
    lines = ["Friedman", f"  chi-squared {statistic:.4f}, p {p:.6f}", f"Nemenyi, critical difference {n.cd:.4f} (textbook {n.cd_textbook:.4f})"]
    lines += ["  " + x for x in _grid("p", methods, [(m, [f"{v:.4f}" for v in row]) for m, row in zip(methods, n.p_values)])]
    pairs = [f"  {a} and {b} differ: p {n.p_values[i, j]:.4f}" for i, a in enumerate(methods) for j, b in enumerate(methods) if i < j and n.p_values[i, j] < 0.05]
    return lines + (pairs or ["  no pair differs at 5 %"])


def metric_report(scores: DataFrame, metric: str) -> str:
    """Scores of one metric, ranks of the methods, their means, and rank tests over the datasets.

    ``scores(dataset, method, metric, score)``; datasets without all methods are left
    out of ranks and tests.
    """
    datasets, methods, matrix = score_matrix(scores.filter(F.col("metric") == metric))
    lines = [f"Metric: {metric}", f"Datasets: {len(datasets)}", f"Methods: {len(methods)}"]
    if not datasets:
        return "\n".join(lines)
    lines += ["", "Scores", *_table(datasets, methods, matrix, "Average", ".4f", ".4f")]
    whole = ~np.isnan(matrix).any(axis=1)
    if whole.any():
        placed = np.array([competition_ranks(row) for row in matrix[whole]], float)
        lines += ["", "Ranks", *_table([d for d, w in zip(datasets, whole) if w], methods, placed, "Average rank", ".0f", ".2f")]
        if len(methods) > 1:
            lines += ["", *_tests(methods, matrix[whole])]
    return "\n".join(lines)


def general_report(scores: DataFrame, name: str, methods: dict[str, str]) -> str:
    """Measures that are no metric, a table each, for all datasets; ``methods`` maps names to keys."""
    found = scores.filter(F.col("metric").isin(list(MEASURES)))
    datasets = score_matrix(found)[0]
    lines = [f"Experiment: {name}", f"Datasets: {', '.join(datasets)}", "Methods:", *[f"  {n} ({k})" for n, k in methods.items()]]
    for measure, (title, cell, mean, missing) in MEASURES.items():
        rows, columns, matrix = score_matrix(found.filter(F.col("metric") == measure))
        if rows:
            matrix[matrix == missing] = np.nan
            lines += ["", title, *_table(rows, columns, matrix, "Mean", cell, mean)]
    return "\n".join(lines)


def critical_difference(scores: DataFrame, metric: str, alpha: float = 0.05) -> list[tuple[str, float, list[int]]]:
    """``(method, average rank, groups)`` of a critical-difference diagram, best first.

    A group is a longest run of methods whose average ranks lie within the textbook
    critical difference; methods outside any group of two have none.
    """
    _, methods, matrix = score_matrix(scores.filter(F.col("metric") == metric))
    matrix = matrix[~np.isnan(matrix).any(axis=1)]
    if not len(matrix) or len(methods) < 2:
        return [(m, 1.0, []) for m in methods]
    from lockstep.functions.stats import nemenyi, ranks

    average = np.array([ranks(-np.round(row, 10)) for row in matrix]).mean(axis=0)
    width = nemenyi(-np.round(matrix, 10), alpha).cd_textbook
    order = np.argsort(average, kind="stable")
    ends = [max(j for j in range(len(order)) if average[order[j]] - average[order[i]] <= width) for i in range(len(order))]
    runs = [(i, e) for i, e in enumerate(ends) if e > i and (i == 0 or ends[i - 1] < e)]
    return [(methods[at], float(average[at]), [g for g, (i, e) in enumerate(runs) if i <= place <= e]) for place, at in enumerate(order)]


def save_text(text: str, path: str, write: Callable[[str, str], None] | None = None) -> None:
    """Write a report; ``write(path, text)`` stands for a file system other than the local one."""
    if write is not None:
        write(path, text)
        return
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text + "\n")
