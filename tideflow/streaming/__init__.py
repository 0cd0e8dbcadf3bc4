"""tideflow.streaming"""
