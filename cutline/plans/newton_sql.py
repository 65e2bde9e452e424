"""DuckDB SQL of Newton fits: imputed and scaled fields, steps by Gauss-Jordan elimination, and scores.

fit() returns named parts.  The rows to fit on come from a part with the columns model, y and the fields;
the rows to score from one with model and the fields.
"""

from __future__ import annotations


def _design(fields: list[str], hot: list[str]) -> str:
    """The list (1, scaled fields, scaled flags, categories) of a row beside its model's statistics."""
    scaled = [f"CASE WHEN s_{f} > 0 THEN (coalesce({f}, m_{f}) - a_{f}) / s_{f} ELSE 0 END" for f in fields]
    flags = [f"CASE WHEN d_{f} > 0 THEN (({f} IS NULL)::INT - b_{f}) / d_{f} ELSE 0 END" for f in fields]
    return "[1.0::DOUBLE, " + ", ".join([*scaled, *flags, *(f"({h})::INT::DOUBLE" for h in hot)]) + "]"


def _moments(k: int, logistic: bool, ridge: str) -> str:
    """The penalised system of a step, a row of the matrix with its right side for every unknown."""
    cell = lambda i, j: f"sum(q * x[{min(i, j)}] * x[{max(i, j)}])" + (f" + {ridge}" if i == j > 1 else "")
    side = lambda i: f"sum((y - p) * x[{i}])" + (f" - ({ridge}) * beta[{i}]" if i > 1 else "")
    rows = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(1, k + 1)), side(i)]) + "]" for i in range(1, k + 1))
    chance = "1 / (1 + exp(-eta))" if logistic else "exp(eta)"
    weight = "p * (1 - p)" if logistic else "p"
    return f"""SELECT model, beta, [{rows}] m FROM (SELECT *, {weight} q FROM (SELECT *, {chance} p FROM (SELECT model, y, x, beta, list_dot_product(x, beta) eta FROM {{x}} JOIN {{beta}} USING (model)))) GROUP BY model, beta"""


def fit(name: str, train: str, test: str, fields: list[str], *, hot: list[str] = (), link: str = "logistic", ridge: str = "1.0", steps: int = 9) -> list[tuple[str, str]]:
    """Parts that end in {name}_scored: the rows of test with p.  ridge is SQL over a group of rows, count(*) being the model's rows."""
    logistic, k = link == "logistic", 1 + 2 * len(fields) + len(hot)
    med = ", ".join(f"coalesce(quantile_cont({f}, 0.5), 0) m_{f}" for f in fields)
    spread = ", ".join(f"avg(coalesce({f}, m_{f})) a_{f}, coalesce(stddev_samp(coalesce({f}, m_{f})), 0) s_{f}, avg(({f} IS NULL)::INT) b_{f}, coalesce(stddev_samp(({f} IS NULL)::INT), 0) d_{f}" for f in fields)
    keep = ", ".join(f"m_{f}" for f in fields)
    start = "ln(greatest(1e-6, least(1 - 1e-6, avg(y))) / (1 - greatest(1e-6, least(1 - 1e-6, avg(y)))))" if logistic else "ln(greatest(1e-6, avg(y)))"
    out = [
        (f"{name}_med", f"SELECT model, {med} FROM {train} GROUP BY 1"),
        (f"{name}_stat", f"SELECT model, {keep}, {spread} FROM {train} JOIN {name}_med USING (model) GROUP BY ALL"),
        (f"{name}_x", f"SELECT model, y::DOUBLE y, {_design(fields, hot)} x FROM {train} JOIN {name}_stat USING (model)"),
        (f"{name}_b0", f"SELECT model, [{start}] || list_transform(range({k - 1}), lambda i: 0.0::DOUBLE) beta FROM {name}_x GROUP BY 1"),
    ]
    for s in range(steps):
        system = _moments(k, logistic, ridge).format(x=f"{name}_x", beta=f"{name}_b{s}")
        pivot = "list_transform(m[i], lambda u: u / m[i][i])"
        swept = "list_transform(m, lambda r, j: CASE WHEN j = i THEN list_transform(r, lambda u: u / m[i][i]) ELSE list_transform(r, lambda u, c: u - r[i] * pr[c]) END)"
        out += [
            (f"{name}_g{s}", f"SELECT 1 i, model, beta, m FROM ({system}) UNION ALL SELECT i + 1, model, beta, {swept} FROM (SELECT *, {pivot} pr FROM {name}_g{s} WHERE i <= {k})"),
            (f"{name}_b{s + 1}", f"SELECT model, list_transform(beta, lambda u, i: u + m[i][{k + 1}]) beta FROM {name}_g{s} WHERE i = {k + 1}"),
        ]
    score = "1 / (1 + exp(-eta))" if logistic else "exp(eta)"
    out.append((f"{name}_scored", f"SELECT *, {score} p FROM (SELECT t.*, list_dot_product({_design(fields, hot)}, beta) eta FROM {test} t JOIN {name}_stat USING (model) JOIN {name}_b{steps} USING (model))"))
    return out


def recursive(text: str) -> str:
    """A statement whose parts may refer to themselves."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)
