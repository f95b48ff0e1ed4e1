"""The trust fold over many identities at once: step t of all identities of a batch is one round of array arithmetic.

The rules are those of `fold.advance`, which stays the definition for one event; here every part of a profile is an array with one entry per
identity. An identity whose rows do not fit one buffer goes through the fold row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from wardline import schemas as C
from wardline.streaming import fold as T

DECISIONS = np.array(["ALLOW", "STEP_UP", "BLOCK"], object)
BANDS = np.array(["LOW", "ELEVATED", "HIGH", "CRITICAL", "DRIFT_REVIEW", "DEGRADED_FAILOPEN", "DEGRADED_FAILCLOSED"], object)
METHODS = np.array([None, "manager_approval", "video_kyc", "otp_sms", "device_biometric"], object)
LOW, ELEVATED, HIGH, CRITICAL, DRIFT_REVIEW, FAIL_OPEN, FAIL_CLOSED = range(7)
NO_METHOD, MANAGER, VIDEO, OTP, BIOMETRIC = range(5)
#: Hours around the clock in order of their distance, and that distance.
OFFSETS = np.array([0, *(s * d for d in range(1, 12) for s in (1, -1)), 12])
AWAY = np.abs(OFFSETS)


class Ring:
    """The last `C.HISTORY` values of each identity."""

    def __init__(self, k: int, longest: int, kind: type):
        self.size = np.zeros(k, np.int64)
        self.values = np.zeros((k, min(C.HISTORY, max(longest, 1))), kind)

    def push(self, who: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put a value in for each identity of `who`; which of them were full, and the value that fell out."""
        full = self.size[who] >= C.HISTORY
        at = self.size[who] % C.HISTORY
        old = self.values[who, at]
        self.values[who, at] = x
        self.size[who] += 1
        return full, old


class Profiles:
    """The state of k identities that have at most `longest` rows each."""

    def __init__(self, k: int, longest: int, devices: int, geos: int):
        zeros = lambda kind=np.float64: np.zeros(k, kind)
        self.trust = np.full(k, C.START_TRUST, np.int64)
        self.allowed, self.devices, self.recovered, self.amount_n = (zeros(np.int64) for _ in range(4))
        self.burst, self.ewma, self.cusum, self.window_start, self.country_at, self.amount_sum = (zeros() for _ in range(6))
        self.prior_used, self.review = zeros(bool), zeros(bool)
        self.country = np.full(k, -1)
        self.knows_device, self.knows_geo = np.zeros(devices, bool), np.zeros(geos, bool)
        self.hours, self.slots = Ring(k, longest, np.int8), np.zeros((k, 24), np.int16)
        self.amounts, self.mean, self.square, self.turns = Ring(k, longest, np.float64), zeros(), zeros(), zeros(np.int64)
        self.risks, self.risk_n = np.zeros((k, C.SHIFT_WINDOW)), zeros(np.int64)

    def hour_distance(self, who: np.ndarray, hour: np.ndarray) -> np.ndarray:
        known = self.slots[who[:, None], (hour[:, None] + OFFSETS) % 24] > 0
        return np.where(known.any(1), AWAY[known.argmax(1)], 6)

    def amount_deviation(self, who: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = np.minimum(self.amounts.size[who], C.HISTORY)
        spread = np.sqrt(np.maximum(np.maximum(self.square[who], 0.0) / np.maximum(n, 1), 1.0))
        far = np.where(n < C.MIN_AMOUNTS, x / C.ABSOLUTE_AMOUNT, np.abs(x - self.mean[who]) / (3 * spread))
        return np.where(np.isnan(x), 0.0, np.minimum(far, 1.0))

    def add_hours(self, who: np.ndarray, hour: np.ndarray) -> None:
        full, old = self.hours.push(who, hour)
        np.subtract.at(self.slots, (who[full], old[full]), 1)
        self.slots[who, hour] += 1

    def add_amounts(self, who: np.ndarray, x: np.ndarray) -> None:
        full, old = self.amounts.push(who, x)
        grow, turn = who[~full], who[full]
        gap = x[~full] - self.mean[grow]
        self.mean[grow] += gap / self.amounts.size[grow]
        self.square[grow] += gap * (x[~full] - self.mean[grow])
        before, x, old = self.mean[turn].copy(), x[full], old[full]
        self.mean[turn] = before + (x - old) / C.HISTORY
        self.square[turn] += (x - old) * (x - self.mean[turn] + old - before)
        self.turns[turn] += 1
        anew = turn[self.turns[turn] >= C.HISTORY]  # summed anew once per turn of the ring
        if len(anew):
            self.mean[anew] = self.amounts.values[anew].mean(1)
            self.square[anew] = ((self.amounts.values[anew] - self.mean[anew, None]) ** 2).sum(1)
            self.turns[anew] = 0

    def drifting(self, who: np.ndarray, risk: np.ndarray, cold: np.ndarray) -> np.ndarray:
        ewma = self.ewma[who]
        self.cusum[who] = np.maximum(0.0, self.cusum[who] + risk - np.where(ewma > 0, ewma, risk) - C.CUSUM_SLACK)
        self.ewma[who] = ewma + np.where(ewma != 0, C.EWMA_ALPHA, 1.0) * (risk - ewma)
        full = who[self.risk_n[who] == C.SHIFT_WINDOW]
        self.risks[full, :-1] = self.risks[full, 1:]
        self.risk_n[who] = np.minimum(self.risk_n[who] + 1, C.SHIFT_WINDOW)
        n = self.risk_n[who]
        self.risks[who, n - 1] = risk
        # the two halves' test is left to the fold for the few windows whose newer half lies higher at all
        half, place = n // 2, np.arange(C.SHIFT_WINDOW)
        old, new = place < half[:, None], (place >= half[:, None]) & (place < n[:, None])
        window = self.risks[who]
        rise = (window * new).sum(1) / np.maximum(n - half, 1) - (window * old).sum(1) / np.maximum(half, 1)
        alarm = self.cusum[who] > C.CUSUM_LIMIT
        for i in np.flatnonzero((n >= C.SHIFT_MIN) & (rise >= C.SHIFT_SIZE - 1e-3) & ~cold & ~alarm).tolist():
            alarm[i] = T.shifted([round(x, 4) for x in window[i, :n[i]].tolist()])
        return alarm

    def move_trust(self, who: np.ndarray, risk: np.ndarray, now: np.ndarray, cap: int) -> None:
        bad = risk > 0.45
        fresh = ~bad & (now - self.window_start[who] > C.RECOVERY_WINDOW)
        self.window_start[who[fresh]], self.recovered[who[fresh]] = now[fresh], 0
        gain = np.minimum(((0.45 - risk) * 60).astype(np.int64), np.maximum(0, cap - self.recovered[who]))
        gain = np.where(bad, 0, gain)
        self.recovered[who] += gain
        self.trust[who] = np.clip(self.trust[who] + np.where(bad, -((risk - 0.45) * 900).astype(np.int64), gain), 0, 1000)

    def settle(self, who: np.ndarray, passed: np.ndarray) -> None:
        good, bad = who[passed], who[~passed]
        self.trust[good] = np.minimum(self.trust[good] + 250, 1000)
        self.review[good], self.cusum[good], self.risk_n[good] = False, 0.0, 0
        self.trust[bad] = np.maximum(self.trust[bad] - 400, 0)


def _codes(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """One number per distinct combination."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own, names = pd.factorize(c, use_na_sentinel=False)
        code = pd.factorize(code * (len(names) + 1) + own)[0]
    return code, int(code.max(initial=-1)) + 1


def fold_identities(rows: pd.DataFrame, p: T.Params) -> pd.DataFrame:
    """Results of whole identities; `rows` come identity by identity, in order of time within each."""
    n = len(rows)
    who, _ = pd.factorize(rows["identity_id"], use_na_sentinel=False)
    begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    length = np.diff(np.r_[begin, n])
    order = np.argsort(-length, kind="stable")  # identities with rows left at step t come first
    begin, length = begin[order], length[order]

    number = lambda c: rows[c].to_numpy(np.float64, na_value=np.nan)
    geo = rows["geo"].fillna("").to_numpy(object)
    device_of, devices = _codes(who, rows["device_id"].to_numpy(object))
    geo_of, geos = _codes(who, geo)
    land = np.array([g.partition("-")[0] for g in geo], object)
    lands, names = pd.factorize(land)
    lands = np.where(land == "", -1, lands)
    event = rows["kind"].to_numpy() != 2
    passed = rows["passed"].eq(True).to_numpy(bool)
    hour = np.nan_to_num(number("hour_of_day")).astype(np.int64) % 24
    amount, ml, now, static = number("amount"), number("ml_risk"), number("ts_seconds"), number("static_risk")
    prior = rows["prior_ok"].eq(True).to_numpy(bool)
    kind = rows["event_type"].to_numpy(object)
    privileged, at_stake = kind == "privileged_access", np.isin(kind.astype(str), ["account_recovery", "onboarding"])
    sensitive = np.isin(kind.astype(str), C.FAIL_CLOSED)
    plain_method = np.where(privileged, MANAGER, np.where(at_stake, VIDEO, NO_METHOD))

    s = Profiles(len(begin), int(length.max(initial=0)), devices, geos)
    out = {c: np.zeros(n) for c in ("new_device", "new_geo", "hour_deviation", "amount_zscore", "velocity", "det_risk", "event_risk", "amount_mean")}
    out |= {c: np.zeros(n, np.int64) for c in ("trust", "risk_band", "decision", "step_up_method", "events_seen", "known_devices")}
    out |= {c: np.zeros(n, bool) for c in ("degraded", "impossible", "drift_review")}
    w = C.WEIGHTS
    for t in range(int(length.max(initial=0))):
        live = np.arange(np.searchsorted(-length, -t, "left"))  # length > t
        at = begin[live] + t
        is_event = event[at]
        if not is_event.all():
            s.settle(live[~is_event], passed[at[~is_event]])
            live, at = live[is_event], at[is_event]
            if not len(live):
                continue
        cold = s.allowed[live] == 0
        device = np.where(cold, 0.4, (~s.knows_device[device_of[at]]).astype(float))
        place = np.where(cold, 0.5, (~s.knows_geo[geo_of[at]]).astype(float))
        hours = s.hour_distance(live, hour[at]) / 12.0
        money = s.amount_deviation(live, amount[at])
        s.burst[live] = s.burst[live] * 0.5 + 1.0
        velocity = np.minimum(s.burst[live] / 15.0, 1.0)
        if p.cold_prior:
            trusted = cold & ~s.prior_used[live] & prior[at]
            device, place = np.where(trusted, device * C.COLD_FACTOR, device), np.where(trusted, place * C.COLD_FACTOR, place)
        s.prior_used[live] |= cold
        det = static[at] + w["new_device"] * device + w["new_geo"] * place + w["hour_deviation"] * hours
        det = np.clip(det + w["amount_zscore"] * money + w["velocity"] * velocity, 0.0, 1.0)
        no_model = np.isnan(ml[at])
        risk = np.where(no_model, det, 0.55 * np.nan_to_num(ml[at]) + 0.45 * det)
        degraded = no_model & p.require_model
        impossible = (s.country[live] >= 0) & (lands[at] != s.country[live]) & (now[at] - s.country_at[live] < C.TRAVEL_SECONDS) & p.travel
        risk = np.where(impossible, np.clip(risk + C.TRAVEL_BOOST, 0.0, 1.0), risk)
        alarm = s.drifting(live, risk, cold) & p.drift
        s.move_trust(live, risk, now[at], p.recovery_cap)
        trust = s.trust[live]
        allow = (trust >= 650) & (risk < 0.45)
        band = np.where(allow, LOW, np.where((trust >= 400) & (risk < 0.65), ELEVATED, np.where(trust >= 150, HIGH, CRITICAL)))
        decision = np.where(allow, 0, np.where(band == CRITICAL, 2, 1))
        usual = np.where(plain_method[at] != NO_METHOD, plain_method[at], np.where(band == HIGH, OTP, BIOMETRIC))
        method = np.where(decision == 1, usual, NO_METHOD)
        review = allow & (alarm | s.review[live])
        s.review[live] |= review
        decision, band = np.where(review, 1, decision), np.where(review, DRIFT_REVIEW, band)
        method = np.where(review, np.where(at_stake[at], VIDEO, OTP), method)
        closed = degraded & sensitive[at]
        method = np.where(closed & (decision == 0), np.where(privileged[at], MANAGER, VIDEO), method)
        decision = np.where(closed & (decision == 0), 1, decision)
        band = np.where(closed, FAIL_CLOSED, np.where(degraded, FAIL_OPEN, band))
        ok = decision == 0
        if ok.any():
            good, here = live[ok], at[ok]
            s.devices[good] += ~s.knows_device[device_of[here]]
            s.knows_device[device_of[here]] = s.knows_geo[geo_of[here]] = True
            s.add_hours(good, hour[here])
            paid = ~np.isnan(amount[here])
            s.add_amounts(good[paid], amount[here[paid]])
            s.amount_sum[good[paid]] += amount[here[paid]]
            s.amount_n[good[paid]] += 1
            s.allowed[good] += 1
            s.country[good], s.country_at[good] = lands[here], now[here]
        for name, value in (("new_device", device), ("new_geo", place), ("hour_deviation", hours), ("amount_zscore", money), ("velocity", velocity), ("det_risk", det),
                            ("event_risk", risk), ("trust", trust), ("risk_band", band), ("decision", decision), ("step_up_method", method), ("degraded", degraded),
                            ("impossible", impossible), ("drift_review", review), ("events_seen", s.allowed[live]), ("known_devices", s.devices[live]),
                            ("amount_mean", np.where(s.amount_n[live] > 0, s.amount_sum[live] / np.maximum(s.amount_n[live], 1), np.nan))):
            out[name][at] = value
    out |= {"decision": DECISIONS[out["decision"]], "risk_band": BANDS[out["risk_band"]], "step_up_method": METHODS[out["step_up_method"]]}
    done = rows.assign(**out)[event]
    return done[[f.split()[0] for f in T.RESULT.split(", ")]]


def runner(params: T.Params, buffer: int = 50_000):
    """mapInPandas body over rows sorted by identity and time. Up to about `buffer` rows wait for their identities to be complete; an
    identity that has more is folded row by row, with only its profile in memory."""
    names = [f.split()[0] for f in T.RESULT.split(", ")]

    def one_by_one(s: T.State, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            if row.kind == 2:
                T.settle(s, bool(row.passed))
            else:
                out.append(T.advance(s, row, params))
        return pd.DataFrame.from_records(out, columns=names)

    def same(pdf: pd.DataFrame, who) -> np.ndarray:
        return (pdf["identity_id"].isna() if who is None else pdf["identity_id"] == who).to_numpy(bool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held, long, state = 0, False, None  # long: an identity that is folded row by row is still going on
        who = None
        for pdf in batches:
            if long:
                mine = same(pdf, who)
                yield one_by_one(state, pdf[mine])
                if mine.all():
                    continue
                long, pdf = False, pdf[~mine]
            waiting.append(pdf)
            held += len(pdf)
            if held < buffer:
                continue
            rows = pd.concat(waiting, ignore_index=True)
            who = rows["identity_id"].iat[-1]
            last = same(rows, who)
            if not last.all():
                yield fold_identities(rows[~last].reset_index(drop=True), params)
            rest = rows[last].reset_index(drop=True)
            waiting, held = [rest], len(rest)
            if held >= buffer:
                long, state = True, T.State()
                yield one_by_one(state, rest)
                waiting, held = [], 0
        if held:
            yield fold_identities(pd.concat(waiting, ignore_index=True), params)

    return run
