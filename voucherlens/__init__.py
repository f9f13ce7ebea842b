"""Coupon-redemption features, models and metrics as Spark DataFrame jobs."""
