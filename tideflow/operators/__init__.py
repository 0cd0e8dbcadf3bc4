"""tideflow.operators"""
