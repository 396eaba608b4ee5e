"""permeate.sinks"""
