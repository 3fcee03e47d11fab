"""SQL text blocks for the cross-checks: the particle view, the pair table and class means in plain SQL.

The blocks use rotation matrices and recursive queries, not the quaternion expressions of the package, so an
agreement is evidence and not an echo.
"""

from __future__ import annotations

RADIUS = 150.0

PARTICLES = """p AS (
  SELECT vec_id AS particle_id, label AS tomo_id, 'tomo' || label AS tomo_name,
    embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z,
    embedding[4]::DOUBLE * 360 AS phi, embedding[5]::DOUBLE * 360 AS psi, abs(embedding[6]::DOUBLE) * 180 AS theta,
    (vec_id % 4)::INT AS cls, embedding[7]::DOUBLE AS score
  FROM embeddings)"""


def matrix(phi: str, psi: str, theta: str, prefix: str = "r") -> str:
    """Select list of the nine elements of ``Rz(psi) Rx(theta) Rz(phi)``."""
    c = {k: f"cos(radians({v}))" for k, v in (("f", phi), ("p", psi), ("t", theta))}
    s = {k: f"sin(radians({v}))" for k, v in (("f", phi), ("p", psi), ("t", theta))}
    cells = [
        f"{c['p']}*{c['f']} - {s['p']}*{c['t']}*{s['f']}", f"-{c['p']}*{s['f']} - {s['p']}*{c['t']}*{c['f']}", f"{s['p']}*{s['t']}",
        f"{s['p']}*{c['f']} + {c['p']}*{c['t']}*{s['f']}", f"-{s['p']}*{s['f']} + {c['p']}*{c['t']}*{c['f']}", f"-{c['p']}*{s['t']}",
        f"{s['t']}*{s['f']}", f"{s['t']}*{c['f']}", c["t"],
    ]
    return ", ".join(f"{e} AS {prefix}{i // 3}{i % 3}" for i, e in enumerate(cells))


def euler(m: dict[str, str] | str) -> tuple[str, str, str]:
    """Rounded ``phi, psi, theta`` of the matrix columns ``<prefix>00..22``."""
    e = (lambda ij: f"{m}{ij}") if isinstance(m, str) else (lambda ij: m[ij])
    flat = f"abs({e('22')} - 1) < 1e-7"
    clamp = f"greatest(-1.0, least(1.0, {e('22')}))"
    rnd = lambda v: f"(round_even({v}, 4) + 0.0)"
    return (
        rnd(f"degrees(CASE WHEN {flat} THEN atan2({e('10')}, {e('00')}) ELSE atan2({e('20')}, {e('21')}) END)"),
        rnd(f"CASE WHEN {flat} THEN 0.0 ELSE degrees(atan2({e('02')}, -({e('12')}))) END"),
        rnd(f"CASE WHEN {flat} THEN 0.0 ELSE degrees(acos({clamp})) END"),
    )


def times(a: str, b: str, prefix: str, a_transposed: bool = False) -> str:
    """Select list of the product of two matrices given by column prefixes."""
    pick = (lambda i, k: f"{a}{k}{i}") if a_transposed else (lambda i, k: f"{a}{i}{k}")
    return ", ".join(
        " + ".join(f"{pick(i, k)}*{b}{k}{j}" for k in range(3)) + f" AS {prefix}{i}{j}"
        for i in range(3) for j in range(3))


def turned(prefix: str, v: tuple[str, str, str], transposed: bool = False) -> list[str]:
    """The three coordinates of a matrix times a vector."""
    return [" + ".join(f"{prefix}{k}{i}*({v[k]})" if transposed else f"{prefix}{i}{k}*({v[k]})" for k in range(3))
            for i in range(3)]


def magnitude(phi: str, psi: str, theta: str) -> str:
    trace = f"((1 + cos(radians({theta}))) * (1 + cos(radians({phi} + {psi}))) - 1)"
    return f"degrees(acos(greatest(-1.0, least(1.0, ({trace} - 1) / 2))))"


def quaternion(phi: str, psi: str, theta: str) -> list[str]:
    h, s, d = f"radians({theta})/2", f"radians({psi}+{phi})/2", f"radians({psi}-{phi})/2"
    return [f"cos({h})*cos({s})", f"sin({h})*cos({d})", f"sin({h})*sin({d})", f"cos({h})*sin({s})"]


def turn(dot: str) -> str:
    return f"2*degrees(acos(least(1.0, abs({dot}))))"


def _pairs() -> str:
    v = turned("a.r", ("b.x - a.x", "b.y - a.y", "b.z - a.z"), True)
    w = turned("b.r", ("a.x - b.x", "a.y - b.y", "a.z - b.z"), True)
    e, inv = euler("m"), euler({f"{i}{j}": f"m{j}{i}" for i in range(3) for j in range(3)})
    rel = ", ".join(" + ".join(f"a.r{k}{i}*b.r{k}{j}" for k in range(3)) + f" AS m{i}{j}" for i in range(3) for j in range(3))
    side = lambda t, k: ", ".join(f"{t}.{c} AS {c}{k}" for c in ("x", "y", "z", "phi", "psi", "theta", "cls"))
    return f"""pm AS MATERIALIZED (SELECT *, {matrix('phi', 'psi', 'theta')} FROM p),
pj AS MATERIALIZED (
  SELECT a.particle_id AS id1, b.particle_id AS id2, a.tomo_id, a.tomo_name, {side('a', 1)}, {side('b', 2)},
    {", ".join(f"{e} AS v{n}" for e, n in zip(v, "xyz"))}, {", ".join(f"{e} AS w{n}" for e, n in zip(w, "xyz"))},
    sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) AS len, {rel}
  FROM pm a JOIN pm b ON a.tomo_id = b.tomo_id AND a.particle_id < b.particle_id
  WHERE sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) <= {RADIUS}),
pe AS MATERIALIZED (
  SELECT * EXCLUDE (m00, m01, m02, m10, m11, m12, m20, m21, m22),
    {e[0]} AS ephi, {e[1]} AS epsi, {e[2]} AS etheta, {inv[0]} AS iphi, {inv[1]} AS ipsi, {inv[2]} AS itheta
  FROM pj),
pr AS MATERIALIZED (
  SELECT *, {magnitude('ephi', 'epsi', 'etheta')} AS ang, (cls1 + cls2) % 4 AS pc,
    row_number() OVER (ORDER BY tomo_id, id1, id2) AS rn
  FROM pe)"""


PAIRS = PARTICLES + ",\n" + _pairs()


def class_means(source: str = "pr", name: str = "cm", condition: str = "pc <> 0") -> str:
    """Mean shift and mean rotation per class ``pc``.

    The mean rotation is the leading eigenvector of the summed quaternion products; repeated squaring of
    the 4x4 matrix leaves its projector, from which the Euler triple is read off directly.
    """
    axes = [(i, j) for i in range(4) for j in range(i, 4)]
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    sums = ", ".join(f"sum(q{i}*q{j}) AS a{i}{j}" for i, j in axes)
    square = {(i, j): " + ".join(f"{at(i, k)}*{at(k, j)}" for k in range(4)) for i, j in axes}
    trace = " + ".join(f"({square[(i, i)]})" for i in range(4))
    step = ", ".join(f"({square[(i, j)]})/({trace})" for i, j in axes)
    start = ", ".join(f"a{i}{j}/(a00+a11+a22+a33) AS a{i}{j}" for i, j in axes)
    m = {"22": "1 - 2*(a11 + a22)", "20": "a13 - a02", "21": "a23 + a01", "02": "a13 + a02", "12": "a23 - a01",
         "10": "2*(a12 + a03)", "00": "1 - 2*(a22 + a33)"}
    e = euler({k: f"({v})" for k, v in m.items()})
    q = quaternion("ephi", "epsi", "etheta")
    return f"""{name}q AS (SELECT *, {", ".join(f"{c} AS q{k}" for k, c in enumerate(q))} FROM {source} WHERE {condition}),
{name}0 AS (SELECT pc, avg(vx) AS cx, avg(vy) AS cy, avg(vz) AS cz, {sums} FROM {name}q GROUP BY pc),
{name}p AS (
  SELECT pc, cx, cy, cz, 0 AS k, {start} FROM {name}0
  UNION ALL
  SELECT pc, cx, cy, cz, k + 1, {step} FROM {name}p WHERE k < 45),
{name} AS MATERIALIZED (SELECT pc, cx, cy, cz, {e[0]} AS cphi, {e[1]} AS cpsi, {e[2]} AS ctheta
  FROM {name}p WHERE k = 45)"""


def to_centre(shift=("vx", "vy", "vz"), e=("ephi", "epsi", "etheta"), weight: float = 1.0, radius: float = RADIUS) -> tuple[str, str, str]:
    """Translation, rotation and combined distance of a row to the centre ``cx .. ctheta`` in it."""
    v = "sqrt(" + " + ".join(f"({a}-c{n})*({a}-c{n})" for a, n in zip(shift, "xyz")) + ")"
    a, b = quaternion(*e), quaternion("cphi", "cpsi", "ctheta")
    ang = turn(" + ".join(f"({x})*({y})" for x, y in zip(a, b)))
    return v, ang, f"(({ang}) + ({v})/(2*{radius})*180*{weight})/2"


def recursive(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n"
