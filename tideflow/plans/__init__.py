"""tideflow.plans"""
