"""tideflow.functions"""
