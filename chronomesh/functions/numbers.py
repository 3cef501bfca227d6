"""Number theory and the thirteen-fold constructions, as frames or plain functions."""

from __future__ import annotations

import cmath
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def primes(spark: SparkSession, n: int) -> DataFrame:
    """(p): primes up to ``n``; each number is crossed out by the multiples of primes up to the root of ``n``."""
    root = math.isqrt(n)
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    base = spark.createDataFrame([(p,) for p in small], "q bigint")
    composite = base.select(F.explode(F.sequence(F.col("q") * F.col("q"), F.lit(n).cast("bigint"), F.col("q"))).alias("p")).distinct()
    return spark.range(2, n + 1).select(F.col("id").alias("p")).join(composite, "p", "left_anti")


def nth_prime(k: int) -> int:
    if k < 1:
        raise ValueError("primes are counted from 1")
    top = 15 if k < 6 else int(k * (math.log(k) + math.log(math.log(k)))) + 1
    flags = bytearray([1]) * (top + 1)
    flags[:2] = b"\0\0"
    for p in range(2, math.isqrt(top) + 1):
        if flags[p]:
            flags[p * p :: p] = bytes(len(range(p * p, top + 1, p)))
    return [p for p in range(top + 1) if flags[p]][k - 1]


def is_prime(n: int) -> bool:
    """Miller-Rabin; its first twelve prime bases decide every number of 64 bits."""
    if n < 2:
        return False
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    for p in bases:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1 + (p > 2)
    return out + ([n] if n > 1 else [])


def semiprime_factors(n: int) -> tuple[int, int] | None:
    own = factors(n)
    return (own[0], own[1]) if len(own) == 2 else None


def pi_family_factors(n: int, k: int) -> tuple[int, int] | None:
    """Factors of a semiprime searched outward from the root over pi to the power k (the family's ratio)."""
    start = max(2, int(math.sqrt(n) / math.pi ** (k / 2)))
    for step in range(n):
        for p in (start - step, start + step):
            if 2 <= p < n and n % p == 0:
                return min(p, n // p), max(p, n // p)
        if start - step < 2 and start + step > n:
            return None
    return None


def zeta(spark: SparkSession, s: float, terms: int) -> DataFrame:
    return spark.range(1, terms + 1).agg(F.sum(1 / F.pow(F.col("id"), F.lit(float(s)))).alias("zeta"))


def zero_count(height: float) -> float:
    """Zeros of zeta up to a height, by the main terms of the counting formula."""
    x = height / (2 * math.pi)
    return x * math.log(x) - x + 7 / 8 if height > 0 else 0.0


def zero_near(n: int) -> float:
    """Height where the count reaches n - 1/2, by bisection."""
    low, high = 10.0, 20.0
    while zero_count(high) < n - 0.5:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if zero_count(mid) < n - 0.5 else (low, mid)
    return (low + high) / 2


def logarithmic_integral(x: float, terms: int = 200) -> float:
    total, power = 0.0, 1.0
    for k in range(1, terms):
        power *= math.log(x) / k
        total += power / k
    return 0.5772156649015329 + math.log(abs(math.log(x))) + total  # Euler's constant


def continued_fraction(x: float, n: int) -> list[int]:
    out = []
    for _ in range(n):
        whole = math.floor(x)
        out.append(whole)
        if abs(x - whole) < 1e-12:
            break
        x = 1 / (x - whole)
    return out


def best_rational(x: float, most: int) -> tuple[int, int]:
    f = Fraction(x).limit_denominator(most)
    return f.numerator, f.denominator


def mod_inverse(a: int, m: int) -> int | None:
    return pow(a, -1, m) if math.gcd(a, m) == 1 else None


def legendre(a: int, p: int) -> int:
    r = pow(a, (p - 1) // 2, p)
    return -1 if r == p - 1 else r


#: fixed value: exponents of the primes in the order of the largest sporadic group
MONSTER = {2: 46, 3: 20, 5: 9, 7: 6, 11: 2, 13: 3, 17: 1, 19: 1, 23: 1, 29: 1, 31: 1, 41: 1, 47: 1, 59: 1, 71: 1}


def monster_order() -> int:
    return math.prod(p**k for p, k in MONSTER.items())


def holds_13_cubed(n: int) -> bool:
    return n % 13**3 == 0 and n % 13**4 != 0


def power_residue(a: int, p: int, n: int = 13) -> int | None:
    """a to the (p - 1) / n modulo p, where n divides p - 1."""
    return pow(a, (p - 1) // n, p) if (p - 1) % n == 0 else None


# thirteen-fold geometry, algebra and graphs

def polygon(spark: SparkSession, n: int = 13) -> DataFrame:
    angle = F.col("id") * (2 * math.pi / n)
    return spark.range(n).select(F.col("id").alias("k"), F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def dihedral(n: int = 13) -> list[list[int]]:
    return [[(k + s) % n for k in range(n)] for s in range(n)] + [[(s - k) % n for k in range(n)] for s in range(n)]


def star_polygon(k: int, n: int = 13) -> list[int] | None:
    """Order of visit with step k; none unless one closed path meets all."""
    return [j * k % n for j in range(n)] if 1 <= k < n and math.gcd(k, n) == 1 else None


def fold_symmetry(points: DataFrame, n: int = 13, most: float = 30.0) -> DataFrame:
    """(symmetric, chi2, peak): how evenly the angles fall on ``n`` sectors; chi-square at most ``most`` is symmetric."""
    sector = F.pmod(F.floor((F.atan2("y", "x") + 2 * math.pi) / (2 * math.pi / n) + 0.5), F.lit(n))
    counts = points.select(sector.alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    m = F.sum("c") / n
    chi = (F.sum(F.col("c") * F.col("c")) - 2 * m * F.sum("c") + n * m * m) / m
    return counts.agg((chi <= most).alias("symmetric"), chi.alias("chi2"), F.max("c").alias("peak"))


def symmetry_scores(points: DataFrame, n: int = 13) -> DataFrame:
    """(geometric, algebraic, graph, overall) in [0, 1]: evenness, size of the n-th circular mode, balance of the sectors."""
    own = fold_symmetry(points, n)
    turn = n * F.atan2("y", "x")
    mode = points.agg((F.sqrt(F.pow(F.avg(F.cos(turn)), 2) + F.pow(F.avg(F.sin(turn)), 2))).alias("algebraic"), F.count("*").alias("m"))
    both = own.join(mode).select(F.exp(-F.col("chi2") / n).alias("geometric"), "algebraic", F.least(F.col("m") / n / F.col("peak"), F.lit(1.0)).alias("graph"))
    return both.withColumn("overall", (F.col("geometric") + F.col("algebraic") + F.col("graph")) / 3)


def roots_of_unity(n: int = 13) -> list[complex]:
    return [cmath.exp(2j * math.pi * k / n) for k in range(n)]


def cyclotomic_13(x: float) -> float:
    return sum(x**k for k in range(13))


def real_subfield_basis(n: int = 13) -> list[float]:
    return [2 * math.cos(2 * math.pi * k / n) for k in range(1, (n + 1) // 2)]


def gaussian_periods_cubic(n: int = 13) -> list[float]:
    """The three periods of the subgroup of cubes (index three)."""
    cubes = sorted({pow(a, 3, n) for a in range(1, n)})
    seen, out = set(), []
    for a in range(1, n):
        if a not in seen:
            coset = {a * c % n for c in cubes}
            seen |= coset
            out.append(sum(math.cos(2 * math.pi * c / n) for c in coset))
    return out


def eta_product(q: complex, powers: dict[int, int], terms: int = 200) -> complex:
    """Product of eta(m tau) to the given powers, as a series in q = exp(2 pi i tau)."""
    out = cmath.exp(cmath.log(q) * sum(m * e for m, e in powers.items()) / 24)
    for m, e in powers.items():
        for k in range(1, terms + 1):
            out *= (1 - q ** (m * k)) ** e
    return out


def cusp_form_13(tau: complex, terms: int = 200) -> complex:
    return eta_product(cmath.exp(2j * math.pi * tau), {1: 2, 13: 2}, terms)


def hauptmodul_13(q: float, terms: int = 200) -> float:
    return eta_product(complex(q), {1: 2, 13: -2}, terms).real


def circulant(spark: SparkSession, steps: list[int], n: int = 13) -> DataFrame:
    """(u, v) with v - u or u - v among ``steps`` modulo n."""
    both = sorted({s % n for s in steps} | {-s % n for s in steps} - {0})
    return spark.range(n).select(F.col("id").alias("u"), F.explode(F.array(*[F.lit(s) for s in both])).alias("s")).select("u", F.pmod(F.col("u") + F.col("s"), F.lit(n)).alias("v")).distinct()


def paley(spark: SparkSession, n: int = 13) -> DataFrame:
    return circulant(spark, sorted({a * a % n for a in range(1, n)}), n)


def graph_cover(base: DataFrame, n: int = 13) -> DataFrame:
    """(u, v) of the n-fold cover of (u, v, voltage): vertex x becomes x * n + k, an edge goes from k to k + voltage."""
    return base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        (F.col("u") * n + F.col("k")).alias("u"), (F.col("v") * n + F.pmod(F.col("k") + F.col("voltage"), F.lit(n))).alias("v")
    )


def is_regular(edges: DataFrame, degree: int = 13) -> DataFrame:
    each = edges.distinct().groupBy("u").agg(F.count("*").alias("d"))
    return each.agg((F.min("d") == degree).alias("low"), (F.max("d") == degree).alias("high")).select((F.col("low") & F.col("high")).alias("regular"))


def rotation_symmetry(adjacency: list[list[int]], n: int = 13) -> tuple[bool, list[list[int]]]:
    """(whether moving every vertex by some step of whole orbits of n is an automorphism, the orbits)."""
    size = len(adjacency)
    if size % n:
        return False, []
    near = [set(a) for a in adjacency]

    def moved(v: int) -> int:
        return v // n * n + (v % n + 1) % n

    good = all({moved(w) for w in near[v]} == near[moved(v)] for v in range(size))
    return good, [list(range(k, k + n)) for k in range(0, size, n)] if good else []


def girth(adjacency: list[list[int]]) -> int | None:
    best = None
    for root in range(len(adjacency)):
        depth, parent, queue = {root: 0}, {root: -1}, [root]
        for u in queue:
            for v in adjacency[u]:
                if v not in depth:
                    depth[v], parent[v] = depth[u] + 1, u
                    queue.append(v)
                elif parent[u] != v:
                    best = min(best or 10**9, depth[u] + depth[v] + 1)
    return best


def cage(adjacency: list[list[int]], degree: int = 13) -> tuple[int, str] | None:
    """(girth, description) of a regular graph of this degree, else none."""
    if not adjacency or any(len(set(a)) != degree for a in adjacency):
        return None
    g = girth([sorted(set(a)) for a in adjacency])
    bound = 1 + degree * sum((degree - 1) ** k for k in range((g - 1) // 2)) if g and g % 2 else 2 * sum((degree - 1) ** k for k in range((g or 2) // 2))
    return (g, f"({degree},{g}), {len(adjacency)} vertices, lower bound {bound}") if g else None


def multiples_of_13(masses: DataFrame) -> DataFrame:
    """(name, k, sigma, within): distance of (name, mass, error) to the nearest multiple of 13 in errors; under 3 is within."""
    k = F.greatest(F.round(F.col("mass") / 13), F.lit(1.0))
    sigma = F.abs(F.col("mass") - 13 * k) / F.col("error")
    return masses.select("name", k.cast("bigint").alias("k"), sigma.alias("sigma"), (sigma < 3).alias("within"))


def binomial_exactly(n: int, k: int, p: float) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


def digits_value(digits: DataFrame) -> DataFrame:
    """(value) of (pos, digit): the sum of digit / 10 ** pos."""
    return digits.agg(F.sum(F.col("digit") * F.pow(F.lit(10.0), -F.col("pos"))).alias("value"))


def compression_table(rows: DataFrame) -> DataFrame:
    """(name, raw_bits, ratio) of (name, symbols, info): 64 bits a symbol."""
    return rows.select("name", (F.col("symbols") * 64).alias("raw_bits"), (F.col("symbols") * 64 / F.col("info")).alias("ratio"))


def transfer_score(rows: DataFrame) -> DataFrame:
    """(name, score) of (name, info, universality, actionable)."""
    return rows.select("name", (F.log10("info") * F.col("universality") * F.when(F.col("actionable"), 2.0).otherwise(1.0)).alias("score"))


def target_score(rows: DataFrame) -> DataFrame:
    """(score): mean over (value, target) of 1 within a tenth, else 1 less the relative miss."""
    miss = F.abs(F.col("value") / F.col("target") - 1)
    return rows.agg(F.avg(F.when(miss < 0.1, F.lit(1.0)).otherwise(1 - miss)).alias("score"))
