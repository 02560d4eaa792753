"""Small result tables as text: Markdown, LaTeX, plot coordinates.  Inputs are a row for each configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report prints at most; reports are made from results, not data.
MOST = 10_000


def _cell(x, digits: int = 4) -> str:
    return f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x)


def markdown(df: DataFrame, digits: int = 4) -> str:
    rows = df.limit(MOST).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(x, digits) for x in r) + " |" for r in rows]) + "\n"


def latex(df: DataFrame, group: str, digits: int = 3) -> str:
    """A rule between values of ``group``, whose name is printed once."""
    out, last = [" & ".join(df.columns) + r" \\", r"\midrule"], None
    for r in df.limit(MOST).collect():
        if last is not None and r[group] != last:
            out.append(r"\midrule")
        out.append(" & ".join("" if c == group and r[c] == last else _cell(r[c], digits) for c in df.columns) + r" \\")
        last = r[group]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", *out, r"\bottomrule", r"\end{tabular}", ""])


def coordinates(df: DataFrame, x: str, y: str) -> str:
    return "".join(f"({r[0]},{r[1]:.4f})" for r in df.select(x, y).orderBy(x).limit(MOST).collect())


def p_text(p: float) -> str:
    return "<0.001" if p < 0.001 else f"{p:.3f}"


def p_latex(p: float) -> str:
    return "$<0.001$" if p < 0.001 else f"{p:.3f}"


def config_report(results: DataFrame, features: DataFrame, title: str = "Detectors") -> str:
    """A section for each configuration: its data, its rates, its confusion, and its features' tests.

    results: config, n, pos, auc, lo, hi, threshold, tp, fp, fn, tn and the rates; features: config, feature, i_mean,
    i_std, v_mean, v_std, d, p.
    """
    tests: dict[str, list] = {}
    for r in features.orderBy("config", "feature").limit(MOST).collect():
        tests.setdefault(r["config"], []).append(r)
    out = [f"# {title}", ""]
    for r in results.orderBy("config").limit(MOST).collect():
        share = lambda k, r=r: f"{k} ({100 * k / r['n']:.1f}%)"
        tp, fp, fn, tn = (int(r[k]) for k in ("tp", "fp", "fn", "tn"))
        out += [f"## {r['config']}", "", f"- samples: {r['n']}", f"- positives: {share(r['pos'])}", f"- negatives: {share(r['n'] - r['pos'])}", ""]
        out += [f"- AUC {r['auc']:.4f} [{r['lo']:.4f}, {r['hi']:.4f}]", f"- recall {r['recall']:.4f} ({tp}/{tp + fn})", f"- precision {r['precision']:.4f} ({tp}/{tp + fp})", f"- F1 {r['f1']:.4f}", f"- specificity {r['specificity']:.4f}", f"- FPR {r['fpr']:.4f}", f"- threshold {r['threshold']:.4f}", ""]
        out += ["| | predicted negative | predicted positive |", "|---|---|---|", f"| negative | {tn} | {fp} |", f"| positive | {fn} | {tp} |", ""]
        out += ["| feature | positive | negative | d | p | |", "|---|---|---|---|---|---|"]
        for t in tests.get(r["config"], []):
            stars = "***" if t["p"] < 0.001 else "**" if t["p"] < 0.01 else "*" if t["p"] < 0.05 else "ns"
            out.append(f"| {t['feature']} | {t['i_mean']:.4f}\u00b1{t['i_std']:.4f} | {t['v_mean']:.4f}\u00b1{t['v_std']:.4f} | {t['d']:+.3f} | {t['p']:.2e} | {stars} |")
        out.append("")
    return "\n".join(out)


def baseline_table(best: DataFrame, likelihoods: DataFrame | None = None, bench: DataFrame | None = None, bench_name: str = "bench") -> str:
    """LaTeX rows by model: spectral metrics first, then the likelihood baselines that the model has, then a bench's section.

    All have feature, auc, recall, precision, detected, d, p; ``best`` and ``likelihoods`` also model.  Of the bench the
    best row of each metric is taken (features are named L<layer>_<metric>).
    """
    from quarry.operators.features import METRICS

    def line(name: str, feature: str, r) -> str:
        return f"{name} & {feature} & {r['auc']:.4f} & {r['recall']:.4f} & {r['precision']:.4f} & {int(r['detected'])} & {r['d']:.3f} & {p_latex(r['p'])} \\\\"

    extra: dict[str, list] = {}
    for r in likelihoods.orderBy("model", "feature").limit(MOST).collect() if likelihoods is not None else []:
        extra.setdefault(r["model"], []).append(r)
    out, last, rows = [], None, best.orderBy("model", "feature").limit(MOST).collect()
    for i, r in enumerate(rows):
        model = r["model"]
        if last is not None and model != last:
            out.append(r"\midrule")
        out.append(line(rf"\textbf{{{model.replace('-8B', '').replace('-7B', '')}}}" if model != last else "", r["feature"], r))
        last = model
        if i + 1 == len(rows) or rows[i + 1]["model"] != model:
            out += [line("", x["feature"], x) for x in extra.get(model, [])]
    if bench is not None:
        found = bench.limit(MOST).collect()
        tops = [(m, max((r for r in found if m in r["feature"]), key=lambda r: r["auc"], default=None)) for m in METRICS]
        named = [(m, r) for m, r in tops if r is not None]
        if named:
            out.append(r"\midrule")
            out += [line(rf"\textbf{{{bench_name}}}" if i == 0 else "", m, r) for i, (m, r) in enumerate(named)]
    head = "model & feature & AUC & recall & precision & detected & d & p \\\\"
    return "\n".join([r"\begin{tabular}{llrrrrrr}", r"\toprule", head, r"\midrule", *out, r"\bottomrule", r"\end{tabular}", ""])


def plot_source(profile: DataFrame, title: str) -> str:
    """A PGF plot of a layer profile (layer, v_mean, i_mean and bands): two lines, two bands, and the table as comments."""
    rows = profile.orderBy("layer").limit(MOST).collect()
    path = lambda c: "".join(f"({r['layer']},{r[c]:.4f})" for r in rows)
    out = [r"\begin{tikzpicture}", rf"\begin{{axis}}[title={{{title}}}, xlabel={{layer}}]"]
    for s, name, colour in (("v", "negative", "blue"), ("i", "positive", "red")):
        out += [rf"\addplot[name path={s}u, draw=none] coordinates {{{path(f'{s}_upper')}}};", rf"\addplot[name path={s}l, draw=none] coordinates {{{path(f'{s}_lower')}}};"]
        out += [rf"\addplot[{colour}, opacity=0.2] fill between[of={s}u and {s}l];", rf"\addplot[{colour}] coordinates {{{path(f'{s}_mean')}}};", rf"\addlegendentry{{{name}}}"]
    table = ["% " + ",".join(("layer", "v_mean", "v_std", "i_mean", "i_std")), *("% " + ",".join([str(r["layer"]), *(f"{r[c]:.4f}" for c in ("v_mean", "v_std", "i_mean", "i_std"))]) for r in rows)]
    return "\n".join([*out, r"\end{axis}", r"\end{tikzpicture}", *table, ""])


def console(df: DataFrame, by: str, k: int = 10) -> str:
    """The k rows of largest ``by`` as Markdown."""
    return markdown(df.orderBy(df[by].desc()).limit(k))


def interval(lo: float, hi: float) -> str:
    return f"[{lo:.4f}, {hi:.4f}]"


def percent(x: float) -> str:
    return f"{100 * x:.1f}%"
