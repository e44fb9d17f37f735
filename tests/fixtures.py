"""Hand-made inputs for unit tests (the reference's own seed set and edge rows)."""

# The reference's 25-row seed set (its test input), as fixed values.
SEED = {
    "customer_id": [f"CUST_{i + 1:05d}" for i in range(25)],
    "tenure_months": [12, 24, 36, 4, 8, 48, 1, 15, 60, 3, 10, 20, 30, 40, 50, 6, 18, 32, 44, 55, 9, 21, 33, 45, 11],
    "monthly_charges": [70.0, 85.0, 100.0, 55.0, 65.0, 110.0, 45.0, 75.0, 95.0, 50.0, 60.0, 80.0, 90.0, 105.0, 115.0,
                        52.0, 72.0, 88.0, 92.0, 102.0, 58.0, 78.0, 84.0, 98.0, 68.0],
    "support_tickets": [0, 1, 0, 4, 2, 0, 5, 1, 0, 3, 2, 1, 0, 1, 0, 3, 1, 0, 0, 1, 2, 1, 0, 0, 1],
    "customer_satisfaction_score": [5, 4, 5, 2, 3, 5, 1, 4, 5, 2, 3, 4, 5, 4, 5, 2, 4, 5, 5, 4, 3, 4, 5, 5, 4],
    "payment_delays": [0, 1, 0, 4, 2, 0, 7, 1, 0, 3, 2, 1, 0, 2, 0, 5, 1, 0, 0, 1, 3, 1, 0, 0, 2],
    "product_usage": [15.5, 25.0, 35.5, 8.0, 12.5, 45.0, 5.0, 18.0, 38.5, 6.0, 10.5, 22.0, 32.5, 42.0, 48.5, 7.0, 20.0,
                      30.5, 40.0, 46.5, 11.0, 23.0, 28.5, 44.0, 14.5],
    "complaint_count": [0, 0, 0, 2, 1, 0, 3, 0, 0, 1, 1, 0, 0, 1, 0, 2, 0, 0, 0, 0, 1, 0, 0, 0, 0],
    "churned": [0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0],
}


def seed_frame(spark, churned=None):
    import pandas as pd
    data = dict(SEED)
    if churned is not None:
        data["churned"] = [churned] * 25
    return spark.createDataFrame(pd.DataFrame(data))
