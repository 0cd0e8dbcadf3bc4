"""tideflow.sources"""
