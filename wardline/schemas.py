"""Table schemas and the fixed values every rule refers to."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: enumerations -------------------------------------------------
EVENT_TYPES = ["login", "transaction", "onboarding", "account_recovery", "privileged_access", "profile_change"]
CHANNELS = ["mobile_app", "internet_banking", "branch", "api", "admin_console"]
DECISIONS = ["ALLOW", "STEP_UP", "BLOCK"]
STEP_UP_METHODS = ["device_biometric", "otp_sms", "security_questions", "video_kyc", "manager_approval"]

# ---- fixed values: risk tables --------------------------------------------------
CRITICALITY = {
    "login": 0.2,
    "transaction": 0.4,
    "profile_change": 0.5,
    "onboarding": 0.6,
    "account_recovery": 0.8,
    "privileged_access": 0.9,
}
CHANNEL_RISK = {
    "branch": 0.1,
    "mobile_app": 0.3,
    "internet_banking": 0.4,
    "api": 0.5,
    "admin_console": 0.7,
}
# feature order, weight, benign baseline
FEATURES = [
    "new_device", "new_geo", "hour_deviation", "amount_zscore", "behavior_anomaly", "event_criticality",
    "channel_risk", "new_beneficiary", "recovery_change", "velocity", "device_sharing",
]
WEIGHTS = dict(zip(FEATURES, [0.14, 0.10, 0.05, 0.11, 0.15, 0.07, 0.04, 0.08, 0.12, 0.04, 0.10]))
BASELINE = dict(zip(FEATURES, [0.0, 0.0, 0.0, 0.0, 0.1, 0.2, 0.3, 0.0, 0.0, 0.0, 0.0]))

# ---- fixed values: texts --------------------------------------------------------
REASON_TEXT = {
    "new_device": "NEW_DEVICE: first time this device is used for this identity",
    "new_geo": "GEO_ANOMALY: activity from an unseen location bucket",
    "hour_deviation": "TIME_ANOMALY: activity far outside usual hours",
    "amount_zscore": "AMOUNT_ANOMALY: amount deviates strongly from history",
    "behavior_anomaly": "BEHAVIOUR_MISMATCH: typing/swipe pattern does not match owner",
    "event_criticality": "SENSITIVE_ACTION: inherently high-risk operation",
    "channel_risk": "CHANNEL_RISK: elevated-risk channel",
    "new_beneficiary": "NEW_BENEFICIARY: payment to a never-seen payee",
    "recovery_change": "RECOVERY_CHANGE: recovery contact being modified",
    "velocity": "VELOCITY: unusually rapid activity burst",
    "device_sharing": "DEVICE_SHARING: device linked to multiple identities (mule-farm pattern)",
}
NORMAL_REASON = "NORMAL: behaviour consistent with identity baseline"
DRIFT_REASON = "DRIFT_REVIEW: sustained low-and-slow risk increase - secondary review"
TRAVEL_REASON = "IMPOSSIBLE_TRAVEL: geo changed faster than physically possible"
CLIENT_MESSAGE = {
    "ALLOW": "Approved.",
    "STEP_UP": "Additional verification is required to continue.",
    "BLOCK": "This request could not be completed. Please contact support.",
}
COUNTERFACTUAL_SENTENCES = {
    "usual_before": "Would have scored materially lower if the amount were closer to ≈ ₹",
    "usual_after": " (this identity's typical range).",
    "vague": "Would have scored lower if the amount were closer to this identity's normal range.",
    "none": "No single factor dominated; behaviour was broadly consistent.",
    "lower_if": "Would have scored lower if ",
}
COUNTERFACTUAL_TEXT = {
    "new_device": "the device were already recognised for this identity",
    "new_geo": "the login came from a known location",
    "hour_deviation": "the activity were within the usual hours",
    "amount_zscore": "the amount were closer to this identity's normal range",
    "behavior_anomaly": "the behavioural-biometric match were stronger",
    "event_criticality": "the action were lower-risk",
    "channel_risk": "the channel were lower-risk",
    "new_beneficiary": "the payee were already known",
    "recovery_change": "the recovery contact were not being changed",
    "velocity": "the activity were less rapid",
    "device_sharing": "the device were not shared across identities",
}

# ---- fixed values: thresholds ---------------------------------------------------
NEUTRAL_BEHAVIOR = 0.5
HISTORY = 200                 # hours and amounts remembered per identity
MIN_AMOUNTS = 5
ABSOLUTE_AMOUNT = 100_000.0
START_TRUST = 700
RECOVERY_CAP = 120
RECOVERY_WINDOW = 3600.0
COLD_FACTOR = 0.5
COLD_MAX_AMOUNT = 25_000.0
TRAVEL_SECONDS = 3600.0
TRAVEL_BOOST = 0.5
EWMA_ALPHA = 0.03
CUSUM_SLACK = 0.015
CUSUM_LIMIT = 0.4
SHIFT_WINDOW = 12
SHIFT_MIN = 8
SHIFT_SIZE = 0.08
# smallest Kolmogorov-Smirnov distance with exact two-sided p < 0.05 for halves of n values
KS_LIMIT = {8: 1.0, 9: 1.0, 10: 1.0, 11: 4 / 5, 12: 5 / 6}
COST_FP = 17.0
FPR_TARGETS = [0.001, 0.005, 0.01, 0.02, 0.05]
FAIL_CLOSED = ["privileged_access", "account_recovery", "onboarding"]
GENESIS = "0" * 64

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


EVENT = _struct(
    event_id=L, ts=T.TimestampType(), identity_id=S, event_type=S, channel=S, device_id=S, geo=S, hour_of_day=I,
    amount=D, is_new_beneficiary=B, recovery_contact_changed=B, privileged_scope=S, device_attestation=S,
    behavior_assertion=S, idempotency_key=S,
)
REQUIRED = ["event_id", "ts", "identity_id", "event_type", "channel", "device_id", "geo", "hour_of_day"]

# ---- fixed values: column names of the source files ----------------------------
PAYMENTS = _struct(
    step=I, type=S, amount=D, nameOrig=S, oldbalanceOrg=D, newbalanceOrig=D, nameDest=S, oldbalanceDest=D,
    newbalanceDest=D, isFraud=T.ByteType(), isFlaggedFraud=T.ByteType(),
)
LOGIN_COLUMNS = {
    "Login Timestamp": "login_ts", "User ID": "user_id", "Round-Trip Time [ms]": "rtt_ms", "Country": "country",
    "ASN": "asn", "Browser Name and Version": "browser_full", "OS Name and Version": "os_full",
    "Device Type": "device_type", "Login Successful": "success", "Is Attack IP": "attack_ip",
    "Is Account Takeover": "takeover",
}
CARD_NUM = (
    ["TransactionAmt", "card1", "card2", "card3", "card5", "addr1", "addr2", "dist1", "dist2"]
    + [f"C{i}" for i in range(1, 15)] + ["D1", "D2", "D3", "D4", "D5", "D10", "D15"]
)
CARD_CAT = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain"] + [f"M{i}" for i in range(1, 10)]
IDENTITY_NUM = ["id_01", "id_02", "id_05", "id_06", "id_11"]
IDENTITY_CAT = ["DeviceType", "DeviceInfo", "id_30", "id_31", "id_15", "id_28", "id_29"]
